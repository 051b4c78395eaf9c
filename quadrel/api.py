"""One function for each task of the command line: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dims, geo
from .operators import graph, local, policy, raster, splits
from .operators import study as studies
from .sources import sinks


def provenance_check(registry: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """finding, source_id."""
    found = policy.findings(registry)
    if manifests is None:
        return found
    more = [("unknown", policy.unknown(manifests, registry)), ("version", policy.unpinned(manifests, registry)), ("export", policy.not_for_export(manifests, registry))]
    for name, rows in more:
        found = found.unionByName(rows.select(F.lit(name).alias("finding"), "source_id").distinct())
    return found


def provenance_attribution(registry: DataFrame, manifests: DataFrame) -> DataFrame:
    return policy.attribution(manifests, registry).orderBy("first_id")


def provenance_can_export(registry: DataFrame, manifests: DataFrame) -> DataFrame:
    """tile, class, blocked: what a tile may be shipped as, and whether something stands against it."""
    kind = policy.redistribution(manifests, registry)
    bad = policy.not_for_export(manifests, registry).select("tile").union(policy.conflicts(manifests, registry).select("tile")).distinct().withColumn("blocked", F.lit(True))
    return kind.join(bad, "tile", "left").select("tile", F.col("inputs").alias("class"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def tiles_plan(spark: SparkSession, bounds: tuple[float, float, float, float], zone: int, size: float = 1000.0) -> DataFrame:
    """tile_id, ix, iy of the tiles that cover bounds, row by row."""
    minx, miny, maxx, maxy = bounds
    span = lambda a, b: F.sequence(F.floor(F.lit(a) / size), F.ceil(F.lit(b) / size) - 1)
    t = spark.range(1).select(F.explode(span(miny, maxy)).alias("iy")).withColumn("ix", F.explode(span(minx, maxx)))
    return t.select(geo.tile_id(F.lit(zone), F.col("ix"), F.col("iy")).alias("tile_id"), "ix", "iy").orderBy("iy", "ix")


def tiles_channels(spark: SparkSession) -> DataFrame:
    return dims.channels(spark).orderBy("ord")


def tiles_build(points: DataFrame, rows: int, cols: int, resolution: float = 1.0, min_coverage: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(tile, row, col, elevation, slope, roughness of the tiles that are covered; tile, coverage, reason of those that aren't)."""
    grid = raster.dense(raster.grid_mean(points, 0.0, 0.0, rows, cols, resolution), rows, cols)
    covered = grid.groupBy("tile").agg(F.avg(F.col("z").isNotNull().cast("int")).alias("coverage"))
    skipped = covered.where(F.col("coverage") < min_coverage).withColumn("reason", F.lit("coverage below the least"))
    kept = raster.roughness(raster.horn(grid.join(skipped, "tile", "left_anti"), resolution))
    return kept.select("tile", "row", "col", F.col("z").alias("elevation"), raster.slope_percent(F.col("dzdx"), F.col("dzdy")).alias("slope"), "roughness"), skipped


def tiles_inspect(cells: DataFrame, channels: list[str]) -> DataFrame:
    """tile, channel, lo, mean, hi."""
    long = cells.unpivot(["tile"], channels, "channel", "v")
    return long.groupBy("tile", "channel").agg(F.min("v").alias("lo"), F.avg("v").alias("mean"), F.max("v").alias("hi"))


def splits_build(tiles: DataFrame, assignment: DataFrame, buffer: int = 1) -> DataFrame:
    return splits.assigned(tiles, assignment, buffer)


def splits_show(split: DataFrame) -> DataFrame:
    return split.groupBy("part").agg(F.count("*").alias("tiles"), F.countDistinct("site").alias("sites"))


def roads_analyse(edges: DataFrame, area_km2: float) -> DataFrame:
    """graph with edges, km, km_per_km2, crossings, dead_end_ratio, components of measured edges (graph, id, u, v, length)."""
    n = graph.degrees(edges).groupBy("graph").agg(F.count("*").alias("n"), F.count_if(F.col("degree") >= 3).alias("crossings"), F.count_if(F.col("degree") == 1).alias("ends"))
    whole = edges.groupBy("graph").agg(F.count("*").alias("edges"), (F.sum("length") / 1000).alias("km"))
    parts = graph.components(edges).groupBy("graph").agg(F.countDistinct("root").alias("components"))
    rows = whole.join(n, "graph").join(parts, "graph")
    density = F.col("km") / F.lit(area_km2) if area_km2 > 0 else F.lit(0.0)
    return rows.select("graph", "edges", "km", density.alias("km_per_km2"), "crossings", (F.col("ends") / F.col("n")).alias("dead_end_ratio"), "components")


def study(observations: DataFrame, features: list[str], metrics: list[str], iterations: int = 2000, seed: str = "draw") -> DataFrame:
    """feature, metric, n, clusters, rho, lo, hi, verdict."""
    by = ["feature", "metric"]
    rows = studies.pairs(observations, features, metrics)
    sites = sorted(x["site"] for x in rows.select("site").distinct().collect())  # a dimension, not rows
    ends = studies.bootstrap(rows, sites, by, iterations, seed=seed)
    return studies.spearman(rows, by).join(ends, by, "left").withColumn("verdict", studies.verdict(F.col("rho"), F.col("lo"), F.col("hi")))


def world_evaluate(truth: DataFrame, own: DataFrame, radius: float = 15.0) -> DataFrame:
    return local.compare(truth, own, radius)


def generate_roads(cells: DataFrame, rows: int, cols: int, threshold: float = 0.45, cell: float = 1.0, limit: float = 12.0) -> DataFrame:
    """The roads of each tile, as local.ROADS: traced from probability v, repaired, and led by heights z within the grade limit."""
    return local.generate(cells, rows, cols, threshold, cell, limit=limit)


def roads_for_export(roads: DataFrame, road_class: str = "unknown", width_m: float = 4.0) -> DataFrame:
    """Generated roads as export() takes them."""
    return roads.select(F.concat_ws(":", "graph", "id").alias("id"), "line", F.lit(road_class).alias("road_class"), F.lit(width_m).alias("width_m"))


def export(edges: DataFrame, path: str) -> None:
    sinks.write_bundle(edges, path)
