"""Queries of readers' parsing steps, checks before a run, and per-tile reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, geo
from ..operators import splits as SP
from ..sources import files
from . import relations as rel
from .catalog import query
from .catalog import rounded as r
from .q_graph import LEN, measured
from .q_raster import DEM, grid


@query(sql="SELECT c_custkey AS id, CASE WHEN n_nationkey % 4 <> 3 THEN n_name END AS label, n_nationkey % 4 = 3 AS unmapped FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def s14_codelist_labels(spark, sf_dir):
    """Labels of codes out of a dictionary's XML, whatever its namespace (s15); a code without one stays."""
    n = rel.table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 3")
    entry = F.concat(F.lit("<g:dictionaryEntry><g:Definition><g:name>"), F.col("n_nationkey").cast("string"), F.lit("</g:name><g:description>"), F.col("n_name"), F.lit("</g:description></g:Definition></g:dictionaryEntry>"))
    text = n.groupBy((F.col("n_regionkey")).alias("space")).agg(F.concat(F.lit('<g:Dictionary xmlns:g="urn:g">'), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</g:Dictionary>")).alias("xml"))
    labels = files.codelist(text.union(spark.createDataFrame([(99, "no xml <")], text.schema)), "space", "xml")
    labels = labels.select(F.col("code").cast("int").alias("c_nationkey"), "label")
    c = rel.table(spark, sf_dir, "customer").join(F.broadcast(labels), "c_nationkey", "left")  # a list of codes
    return c.select(F.col("c_custkey").alias("id"), "label", F.col("label").isNull().alias("unmapped"))


@query("points", sql="SELECT tile % 5 = 2 AS refused, tile, CASE WHEN tile % 5 = 2 THEN 0 ELSE count(*) END AS n, CASE WHEN tile % 5 = 2 THEN NULL ELSE round(sum(x + y * z), 2) END AS s FROM points GROUP BY tile")
def s21_grid_text(spark, sf_dir):
    """Lines of point text: files with commas have five columns, others three; a ragged file gives nothing and a warning."""
    p = rel.points(spark, sf_dir)
    three = F.concat_ws(" ", "x", "y", "z")
    line = F.when(F.col("tile") % 2 == 0, F.concat_ws(",", F.lit("1"), "x", "y", "z", F.lit("0"))).otherwise(three)
    ragged = F.when((F.col("tile") % 5 == 2) & (F.col("z") == 1), F.lit("7.5")).otherwise(line)
    got, refused = files.point_lines(p.select(F.col("tile").cast("string").alias("path"), ragged.alias("line")))
    sums = got.groupBy("path").agg(F.count("*").alias("n"), r(F.sum(F.col("x") + F.col("y") * F.col("z")), 2).alias("s"))
    every = sums.withColumn("refused", F.lit(False)).unionByName(refused.select("path", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("s"), F.lit(True).alias("refused")))
    return every.select("refused", F.col("path").cast("int").alias("tile"), "n", "s")


@query("points", sql="""WITH f AS (SELECT tile, CAST(floor(x * 8) % 8 AS INTEGER) AS file, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) FILTER (x >= 8 AND x < 10 AND y >= 8 AND y < 10) AS held FROM points GROUP BY ALL)
  SELECT tile, min(file) AS file FROM f WHERE x1 < 10 AND x2 > 8 AND y1 < 10 AND y2 > 8 AND held > 0 GROUP BY tile""")
def j6_first_file_that_holds_points(spark, sf_dir):
    """Of the files whose extent meets a tile's box the first that has points in it; a tile without one is left out."""
    p = rel.points(spark, sf_dir).withColumn("file", (F.floor(F.col("x") * 8) % 8).cast("int"))
    held = F.count_if(geo.contains(tuple(map(F.lit, (8.0, 8.0, 10.0, 10.0))), F.col("x"), F.col("y")))
    f = p.groupBy("tile", "file").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), held.alias("held"))
    meets = geo.overlaps(tuple(map(F.col, ("x1", "y1", "x2", "y2"))), tuple(map(F.lit, (8.0, 8.0, 10.0, 10.0))))
    return f.where(meets & (F.col("held") > 0)).groupBy("tile").agg(F.min("file").alias("file"))


@query("tiles", sql="SELECT site, count(DISTINCT CASE WHEN tile % 7 = 0 THEN 'test' ELSE 'train' END) AS parts FROM tiles GROUP BY site HAVING parts > 1")
def j9_spanning_sites(spark, sf_dir):
    """Sites that stand in both parts of a fold: none may."""
    t = rel.tiles(spark, sf_dir).withColumn("part", F.when(F.col("tile") % 7 == 0, "test").otherwise("train"))
    return SP.spanning_sites(t).withColumn("parts", F.lit(2).cast("long"))


@query("buildings", sql="SELECT id, id % 3 <> 0 AS closed, CASE WHEN id % 3 <> 0 THEN 5 ELSE 4 END AS points FROM buildings")
def p30_closed_rings(spark, sf_dir):
    ring = geo.square(F.col("x"), F.col("y"), F.col("side"))
    b = rel.buildings(spark, sf_dir).withColumn("ring", F.when(F.col("id") % 3 == 0, F.slice(ring, 1, 4)).otherwise(ring))
    return b.select("id", geo.closed(F.col("ring")).alias("closed"), F.size("ring").alias("points"))


@query("buildings", sql="SELECT id, round(side * side, 3) AS area FROM buildings WHERE id % 3 <> 0 AND side > 0 AND id % 5 <> 1")
def r2_burnable_polygons(spark, sf_dir):
    """Rings of three corners at least that enclose an area; the others are never burnt."""
    side = F.when(F.col("id") % 5 == 1, 0.0).otherwise(F.col("side"))
    ring = geo.square(F.col("x"), F.col("y"), side)
    b = rel.buildings(spark, sf_dir).withColumn("ring", F.when(F.col("id") % 3 == 0, F.slice(ring, 1, 3)).otherwise(ring))
    area = F.abs(geo.ring_area(F.col("ring")))
    return b.where((F.size("ring") >= 4) & (area > 0)).select("id", r(area, 3).alias("area"))


@query("buildings", sql="SELECT id, CAST(1000 + i.i AS BIGINT) AS square FROM buildings, range(10) i(i) WHERE x < (i.i + 1) * 100 AND x + side > i.i * 100 AND y < (i.i + 1) * 100 AND y + side > i.i * 100")
def p4_mesh_squares(spark, sf_dir):
    """Squares of a mesh (here those on its diagonal) that share area with a box; touching doesn't count."""
    b = rel.buildings(spark, sf_dir)
    i = F.explode(F.sequence(F.greatest(F.floor(F.col("x") / 100) - 1, F.lit(0)), F.least(F.floor((F.col("x") + F.col("side")) / 100), F.lit(9))))
    c = b.select("id", "x", "y", "side", i.alias("i"))
    own = (F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side"))
    return c.where(geo.overlaps(own, (F.col("i") * 100, F.col("i") * 100, (F.col("i") + 1) * 100, (F.col("i") + 1) * 100))).select("id", (F.col("i") + 1000).alias("square"))


@query(sql="SELECT n_nationkey AS number, CASE WHEN n_nationkey BETWEEN 1 AND 19 THEN 'EPSG:' || (6668 + n_nationkey) END AS crs FROM nation")
def m26_plane_zones(spark, sf_dir):
    n = rel.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("number"), dims.plane_crs(F.col("n_nationkey")).alias("crs"))


@query("ways", "nodes", sql="""WITH p AS (SELECT way, pos, x, y, (id * 13 % 40)::DOUBLE AS z, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead((id * 13 % 40)::DOUBLE) OVER o AS nz FROM ways JOIN nodes ON id = ref WINDOW o AS (PARTITION BY way ORDER BY pos)),
  s AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS d FROM p) SELECT way, round(coalesce(sum(d), 0), 3) AS length, round(coalesce(max(CASE WHEN d > 0 THEN 100 * abs(nz - z) / d END), 0), 3) AS grade FROM s GROUP BY way""")
def m35_steepest_step(spark, sf_dir):
    """Length of a line and the largest grade of its steps."""
    at = rel.ways(spark, sf_dir).join(rel.nodes(spark, sf_dir), F.col("ref") == F.col("id")).withColumn("z", (F.col("id") * 13 % 40).cast("double"))
    got = at.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("line"))
    run = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    grades = geo.steps(F.col("line"), lambda a, b: F.when(run(a, b) > 0, 100 * F.abs(b["z"] - a["z"]) / run(a, b)))
    return got.select("way", r(geo.line_length(F.col("line")), 3).alias("length"), r(F.coalesce(F.array_max(grades), F.lit(0.0)), 3).alias("grade"))


@query("points", sql=f"WITH {DEM}, c AS (SELECT tile, count(z) / count(*)::DOUBLE AS coverage FROM grid GROUP BY tile) SELECT tile, coverage >= 0.7 AS written, CASE WHEN coverage < 0.7 THEN printf('coverage %.3f below 0.700', coverage) ELSE '' END AS reason FROM c")
def a30_build_report(spark, sf_dir):
    """What a build writes and what it leaves out, with the reason."""
    c = grid(spark, sf_dir).groupBy("tile").agg(F.avg(F.col("z").isNotNull().cast("int")).alias("coverage"))
    low = F.col("coverage") < 0.7
    return c.select("tile", (~low).alias("written"), F.when(low, F.format_string("coverage %.3f below 0.700", "coverage")).otherwise("").alias("reason"))


@query("segments", sql=f"""WITH {LEN}, d AS (SELECT graph, node, count(*) AS degree FROM (SELECT graph, id, u AS node FROM edges UNION SELECT graph, id, v FROM edges) GROUP BY ALL),
  n AS (SELECT graph, count(*) AS nodes, count(*) FILTER (degree >= 3) AS junctions, count(*) FILTER (degree = 1) AS dead_ends FROM d GROUP BY graph), e AS (SELECT graph, count(*) AS edges, sum(length) AS total, avg(length) AS mean FROM segs GROUP BY graph)
  SELECT graph, edges, nodes, junctions, dead_ends, round(total, 2) AS total_length_m, round(mean, 4) AS mean_edge_length_m, round(dead_ends / nodes::DOUBLE, 5) AS dead_end_ratio FROM n JOIN e USING (graph)""")
def a27_stage_stats(spark, sf_dir):
    """Counts and lengths of one stage of each graph (part of a24, a28)."""
    d = measured(spark, sf_dir)
    ends = d.select("graph", F.explode(F.array_distinct(F.array("u", "v"))).alias("node")).groupBy("graph", "node").agg(F.count("*").alias("degree"))
    n = ends.groupBy("graph").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") >= 3).alias("junctions"), F.count_if(F.col("degree") == 1).alias("dead_ends"))
    e = d.groupBy("graph").agg(F.count("*").alias("edges"), r(F.sum("length"), 2).alias("total_length_m"), r(F.avg("length")).alias("mean_edge_length_m"))
    return e.join(n, "graph").select("graph", "edges", "nodes", "junctions", "dead_ends", "total_length_m", "mean_edge_length_m", r(F.col("dead_ends") / F.col("nodes"), 5).alias("dead_end_ratio"))


@query("manifests", sql="SELECT tile, source_id, role, CAST(2 AS INTEGER) AS schema_version FROM manifests WHERE tile % 3 <> 1")
def s47_manifests_read(spark, sf_dir):
    """Records of manifests read back from JSON; one of another schema version is refused."""
    m = rel.manifests(spark, sf_dir)
    version = F.when(F.col("tile") % 3 == 1, 1).otherwise(2)
    record = F.struct("source_id", "role")
    text = m.groupBy("tile").agg(F.to_json(F.struct(F.first(version).alias("schema_version"), F.col("tile"), F.collect_list(record).alias("records"))).alias("json"))  # one a tile, of its sources
    got = files.manifests(text.select("json"), 2).where("refused is null")
    return got.select("tile", F.inline("records"), "schema_version")
