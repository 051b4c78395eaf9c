"""Sinks: the tile store, attribution, and bundles for engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STACK_VERSION = 2


def write_tiles(cells: DataFrame, path: str) -> None:
    """Cells (tile_id, ...) partitioned by tile; a tile that is written again replaces the one before."""
    marked = cells.withColumn("stack_version", F.lit(STACK_VERSION))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_id").parquet(path)


def read_tiles(spark: SparkSession, path: str, tiles: list | None = None) -> DataFrame:
    """The store's cells; tiles prune partitions; cells of another stack version are an error."""
    cells = spark.read.parquet(path)
    if tiles is not None:
        cells = cells.where(F.col("tile_id").isin(tiles))
    same = F.when(F.col("stack_version") == STACK_VERSION, True).otherwise(F.raise_error("the store has another stack version").cast("boolean"))
    return cells.where(same).drop("stack_version")


def list_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the tiles, from the partitions alone."""
    return spark.read.parquet(path).select("tile_id").distinct().orderBy("tile_id")


def write_lines(lines: DataFrame, path: str) -> None:
    """A text file of one column of lines, in order of the lines; for a report, not for data."""
    lines.orderBy(lines.columns[0]).coalesce(1).write.mode("overwrite").text(path)


def road_features(edges: DataFrame) -> DataFrame:
    """value: a GeoJSON feature of each edge (id, line array<struct<x, y, z>>, road_class, width_m)."""
    place = F.transform("line", lambda p: F.array(F.bround(p["x"], 3), F.bround(p["y"], 3), F.bround(p["z"], 3)))
    geometry = F.struct(F.lit("LineString").alias("type"), place.alias("coordinates"))
    return edges.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("id", "road_class", "width_m").alias("properties"))).alias("value"))


def write_bundle(edges: DataFrame, path: str) -> None:
    """Line-delimited GeoJSON features in parts, and a manifest with the local frame in metres.

    Features aren't gathered into one document: a reader takes one a line, whatever their number.
    """
    spark = edges.sparkSession
    road_features(edges).write.mode("overwrite").text(f"{path}/roads.geojsonl")
    points = edges.select(F.explode("line").alias("p"))
    frame = points.agg(F.min("p.x").alias("x"), F.min("p.y").alias("y"), (F.max("p.x") - F.min("p.x")).alias("width"), (F.max("p.y") - F.min("p.y")).alias("depth")).first()
    manifest = {"units": "m", "axes": ["east", "north", "up"], "origin": [frame["x"], frame["y"], 0.0], "size": [frame["width"], frame["depth"]], "edges": edges.count()}
    spark.createDataFrame([(manifest,)], "m struct<units: string, axes: array<string>, origin: array<double>, size: array<double>, edges: long>").select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
