"""Queries over road graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, geo
from ..operators import graph as G
from ..operators import rangejoin as J
from . import relations as rel
from .catalog import query
from .catalog import rounded as r

LEN = "segs AS (SELECT *, sqrt(pow(vx - ux, 2) + pow(vy - uy, 2)) AS length, ((degrees(atan2(vx - ux, vy - uy)) % 360) + 360) % 360 AS bearing FROM segments)"


def measured(spark, sf_dir) -> DataFrame:
    dx, dy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    return rel.segments(spark, sf_dir).withColumns({"length": F.hypot(dx, dy), "bearing": geo.bearing(dx, dy)})


def lines(spark, sf_dir) -> DataFrame:
    """way, line: the points of each way in order; a way is a handful of references."""
    at = rel.ways(spark, sf_dir).join(rel.nodes(spark, sf_dir), F.col("ref") == F.col("id"))
    got = at.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return got.select("way", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


WAYS = "at_ AS (SELECT w.way, w.pos, n.x, n.y, lead(n.x) OVER o AS nx, lead(n.y) OVER o AS ny FROM ways w JOIN nodes n ON n.id = w.ref WINDOW o AS (PARTITION BY w.way ORDER BY w.pos))"


@query("ways", "nodes", sql=f"WITH {WAYS} SELECT way, round(coalesce(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 0), 4) AS length FROM at_ GROUP BY way")
def m1_line_length(spark, sf_dir):
    return lines(spark, sf_dir).select("way", r(geo.line_length(F.col("line"))).alias("length"))


@query("ways", "nodes", sql=f"""WITH {WAYS} SELECT way, round(sqrt(pow(max_by(x, pos) - min_by(x, pos), 2) + pow(max_by(y, pos) - min_by(y, pos), 2)), 4) AS straight FROM at_ GROUP BY way""")
def m2_straight_length(spark, sf_dir):
    return lines(spark, sf_dir).select("way", r(geo.straight_length(F.col("line"))).alias("straight"))


@query("ways", "nodes", sql=f"""WITH {WAYS}, s AS (SELECT way, coalesce(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 0) AS l, sqrt(pow(max_by(x, pos) - min_by(x, pos), 2) + pow(max_by(y, pos) - min_by(y, pos), 2)) AS s FROM at_ GROUP BY way)
  SELECT way, round(CASE WHEN s <= 1e-9 THEN 1.0::DOUBLE ELSE l / s END, 4) AS sinuosity FROM s""")
def m3_sinuosity(spark, sf_dir):
    got = lines(spark, sf_dir).select("way", geo.line_length(F.col("line")).alias("l"), geo.straight_length(F.col("line")).alias("s"))
    return got.select("way", r(geo.sinuosity(F.col("l"), F.col("s"))).alias("sinuosity"))


@query("segments", sql=f"WITH {LEN} SELECT id, round(bearing, 4) AS bearing, round(bearing % 180, 4) AS folded FROM segs")
def m4_bearing(spark, sf_dir):
    dx, dy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    return rel.segments(spark, sf_dir).select("id", r(geo.bearing(dx, dy)).alias("bearing"), r(geo.bearing(dx, dy, 180.0)).alias("folded"))


@query("ways", "nodes", sql=f"""WITH {WAYS}, c AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS d FROM at_ WHERE nx IS NOT NULL), t AS (SELECT *, sum(d) OVER (PARTITION BY way ORDER BY pos) AS upto, sum(d) OVER (PARTITION BY way) AS whole FROM c),
  f AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY pos) AS k FROM t WHERE whole > 0 AND upto >= whole / 2 - 1e-9)
  SELECT way, round(x + (nx - x) * greatest(0, (whole / 2 - upto + d) / nullif(d, 0)), 3) AS x, round(y + (ny - y) * greatest(0, (whole / 2 - upto + d) / nullif(d, 0)), 3) AS y FROM f WHERE k = 1 AND d > 0""")
def j19_midpoint(spark, sf_dir):
    """The point half way along: the first step whose running length reaches half."""
    at = rel.ways(spark, sf_dir).join(rel.nodes(spark, sf_dir), F.col("ref") == F.col("id"))
    order = Window.partitionBy("way").orderBy("pos")
    s = at.withColumns({"nx": F.lead("x").over(order), "ny": F.lead("y").over(order)}).where("nx is not null").withColumn("d", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    s = s.withColumns({"upto": F.sum("d").over(order), "whole": F.sum("d").over(Window.partitionBy("way"))}).where((F.col("whole") > 0) & (F.col("upto") >= F.col("whole") / 2 - 1e-9))
    s = s.withColumn("k", F.row_number().over(order)).where("k = 1 and d > 0")
    share = F.greatest(F.lit(0.0), (F.col("whole") / 2 - F.col("upto") + F.col("d")) / F.col("d"))
    return s.select("way", r(F.col("x") + (F.col("nx") - F.col("x")) * share, 3).alias("x"), r(F.col("y") + (F.col("ny") - F.col("y")) * share, 3).alias("y"))


@query("edges", sql="SELECT graph, node, count(*) AS degree FROM (SELECT graph, id, u AS node FROM edges UNION SELECT graph, id, v FROM edges) GROUP BY ALL")
def a7_degree(spark, sf_dir):
    return G.degrees(rel.edges(spark, sf_dir))


@query("edges", sql="SELECT graph, least(degree, 5) AS degree, count(*) AS n FROM (SELECT graph, node, count(*) AS degree FROM (SELECT graph, id, u AS node FROM edges UNION SELECT graph, id, v FROM edges) GROUP BY ALL) GROUP BY ALL")
def a8_degree_histogram(spark, sf_dir):
    return G.degrees(rel.edges(spark, sf_dir)).groupBy("graph", F.least("degree", F.lit(5).cast("long")).alias("degree")).agg(F.count("*").alias("n"))


@query("segments", sql=f"""WITH {LEN}, b AS (SELECT graph, least(floor((bearing % 180) / 5), 35) AS bin, sum(length) AS w FROM segs GROUP BY ALL), s AS (SELECT graph, w / sum(w) OVER (PARTITION BY graph) AS p FROM b)
  SELECT graph, round(greatest(0, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(36)), 4) AS entropy FROM s GROUP BY graph""")
def a9_orientation_entropy(spark, sf_dir):
    e = measured(spark, sf_dir).withColumn("bearing", F.pmod("bearing", F.lit(180.0)))
    return G.orientation_entropy(e).withColumn("entropy", r("entropy"))


@query("segments", sql=f"""WITH {LEN}, d AS (SELECT graph, node, count(*) AS degree FROM (SELECT graph, id, u AS node FROM edges UNION SELECT graph, id, v FROM edges) GROUP BY ALL),
  n AS (SELECT graph, count(*) AS nodes, count(*) FILTER (degree = 1) AS ends, count(*) FILTER (degree >= 3) AS crossings FROM d GROUP BY graph), l AS (SELECT graph, sum(length) AS len FROM segs GROUP BY graph)
  SELECT graph, round(len / 1000, 3) AS km_per_km2, crossings::DOUBLE AS crossings_per_km2, round(ends / nodes::DOUBLE, 5) AS dead_end_ratio FROM n JOIN l USING (graph)""")
def a10_densities(spark, sf_dir):
    """Measures of each graph over its square kilometre."""
    d = G.degrees(rel.edges(spark, sf_dir)).groupBy("graph").agg(F.count("*").alias("n"), F.count_if(F.col("degree") == 1).alias("e"), F.count_if(F.col("degree") >= 3).alias("c"))
    length = measured(spark, sf_dir).groupBy("graph").agg(F.sum("length").alias("l"))
    return d.join(length, "graph").select("graph", r(F.col("l") / 1000, 3).alias("km_per_km2"), F.col("c").cast("double").alias("crossings_per_km2"), r(F.col("e") / F.col("n"), 5).alias("dead_end_ratio"))


CLASS_SQL = dims.values_sql(dims.ROAD_CLASSES, "road_class, rank, min_lod, lanes, width_m, max_grade")


def classed(spark, sf_dir) -> DataFrame:
    """measured edges with the class whose place in the list is class_no."""
    names = F.array(*[F.lit(c[0]) for c in dims.ROAD_CLASSES])
    return measured(spark, sf_dir).withColumn("road_class", F.get(names, F.col("class_no"))).join(dims.road_classes(spark), "road_class")


CLASSED = f"{LEN}, cls AS (SELECT *, row_number() OVER (ORDER BY rank) - 1 AS no FROM {CLASS_SQL}), classed AS (SELECT s.*, c.* EXCLUDE (no) FROM segs s JOIN cls c ON c.no = s.class_no)"


@query("segments", sql=f"WITH {CLASSED} SELECT road_class, any_value(rank) AS rank, count(*) AS n, round(sum(length), 2) AS length FROM classed GROUP BY road_class")
def a12_length_by_class(spark, sf_dir):
    return classed(spark, sf_dir).groupBy("road_class").agg(F.first("rank").alias("rank"), F.count("*").alias("n"), r(F.sum("length"), 2).alias("length")).orderBy("rank")


@query("segments", sql=f"WITH {CLASSED}, l AS (SELECT CAST(i AS INTEGER) AS lod FROM range(5) t(i)), k AS (SELECT lod, u, v, id FROM classed, l WHERE min_lod <= lod) SELECT lod, count(*) AS edges, (SELECT count(*) FROM (SELECT u FROM k b WHERE b.lod = k.lod UNION SELECT v FROM k b WHERE b.lod = k.lod)) AS nodes FROM k GROUP BY lod")
def p8_at_lod(spark, sf_dir):
    """Edges and touched nodes at each level of detail."""
    e = classed(spark, sf_dir).withColumn("lod", F.explode(F.sequence(F.col("min_lod"), F.lit(4))))
    n = e.select("lod", F.explode(F.array("u", "v")).alias("node")).distinct().groupBy("lod").agg(F.count("*").alias("nodes"))
    return e.groupBy("lod").agg(F.count("*").alias("edges")).join(n, "lod")


@query("edges", sql="SELECT count(*) FILTER (u NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 7)) AS no_u, count(*) FILTER (v NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 7)) AS no_v FROM edges")
def gr1_missing_nodes(spark, sf_dir):
    e, n = rel.edges(spark, sf_dir), rel.nodes(spark, sf_dir).where("id % 50 <> 7").select("id")
    lost = lambda c: e.select(F.col(c).alias("id")).join(n, "id", "left_anti").agg(F.count("*").alias(f"no_{c}"))
    return lost("u").withColumn("k", F.lit(1)).join(lost("v").withColumn("k", F.lit(1)), "k").drop("k")


@query("edges", sql="SELECT graph, node, string_agg(other, ',' ORDER BY other) AS others FROM (SELECT graph, u AS node, v AS other FROM edges UNION SELECT graph, v, u FROM edges) GROUP BY ALL")
def gr2_neighbours(spark, sf_dir):
    e = rel.edges(spark, sf_dir)
    both = e.select("graph", F.col("u").alias("node"), F.col("v").alias("other")).unionByName(e.select("graph", F.col("v").alias("node"), F.col("u").alias("other")))
    return both.groupBy("graph", "node").agg(F.array_join(F.sort_array(F.collect_set("other")).cast("array<string>"), ",").alias("others"))


@query("edges", sql="WITH d AS (SELECT node, count(*) AS degree FROM (SELECT id, u AS node FROM edges UNION SELECT id, v FROM edges) GROUP BY ALL) SELECT p_partkey AS id, coalesce(degree, 0) AS degree, CASE WHEN degree = 1 THEN 'endpoint' ELSE 'intersection' END AS kind FROM part LEFT JOIN d ON node = p_partkey WHERE coalesce(degree, 0) <= 1")
def gr3_ends_and_isolated(spark, sf_dir):
    """Nodes of degree 1 and 0 with their kind (p31)."""
    e = rel.edges(spark, sf_dir).withColumn("graph", F.lit(0))
    d = G.degrees(e).select(F.col("node").alias("id"), "degree")
    n = rel.nodes(spark, sf_dir).join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).where("degree <= 1")
    return n.select("id", "degree", F.when(F.col("degree") == 1, "endpoint").otherwise("intersection").alias("kind"))


# labels fall to the least of a neighbour's, one step a round; a round holds only what changed
REACH = """WITH RECURSIVE b AS (SELECT graph, u AS n, v AS o FROM edges UNION SELECT graph, v, u FROM edges),
  roots(graph, node, root) USING KEY (graph, node) AS (SELECT DISTINCT graph, n, n FROM b UNION
    SELECT b.graph, b.n, min(c.root) FROM b JOIN roots c ON c.graph = b.graph AND c.node = b.o JOIN recurring.roots own ON own.graph = b.graph AND own.node = b.n GROUP BY b.graph, b.n, own.root HAVING min(c.root) < own.root)"""


@query("edges", sql=REACH + " SELECT graph, node, root FROM roots")
def gr5_components(spark, sf_dir):
    return G.components(rel.edges(spark, sf_dir)).select("graph", "node", "root")


@query("edges", sql=REACH + ", n AS (SELECT graph, root, count(*) AS nodes FROM roots GROUP BY ALL) SELECT graph, root, nodes FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY nodes DESC, root) AS k FROM n) WHERE k = 1")
def t5_largest_component(spark, sf_dir):
    n = G.components(rel.edges(spark, sf_dir)).groupBy("graph", "root").agg(F.count("*").alias("nodes"))
    return n.groupBy("graph").agg(F.max(F.struct("nodes", (-F.col("root")).alias("k"))).alias("m")).select("graph", (-F.col("m.k")).alias("root"), "m.nodes")


@query("segments", sql=REACH + f", {LEN}, p AS (SELECT s.*, r.root FROM segs s JOIN roots r ON r.graph = s.graph AND r.node = s.u) SELECT graph, id FROM p QUALIFY sum(length) OVER (PARTITION BY graph, root) >= 900")
def gr15_drop_small(spark, sf_dir):
    return G.drop_small(measured(spark, sf_dir), 900.0).select("graph", "id")


@query("segments", sql=f"WITH {LEN} SELECT graph, least(u, v) AS a, greatest(u, v) AS b, round(min(length), 3) AS length FROM segs WHERE u <> v GROUP BY ALL")
def gr6_shortest_parallel(spark, sf_dir):
    return G.shortest_parallel(measured(spark, sf_dir)).withColumn("length", r("length", 3))


PRUNE = ", {b} AS (SELECT * FROM {a} WHERE NOT (length < 400 AND (graph, id) IN (SELECT e.graph, e.id FROM {a} e, (SELECT graph, node FROM (SELECT graph, id, u AS node FROM {a} UNION SELECT graph, id, v FROM {a}) GROUP BY ALL HAVING count(*) = 1) d WHERE d.graph = e.graph AND (d.node = e.u OR d.node = e.v))))"


@query("segments", sql=f"WITH {LEN}, p0 AS (SELECT graph, id, u, v, length FROM segs){PRUNE.format(a='p0', b='p1')}{PRUNE.format(a='p1', b='p2')}{PRUNE.format(a='p2', b='p3')} SELECT graph, id FROM p3")
def gr14_prune_spurs(spark, sf_dir):
    return G.prune_spurs(measured(spark, sf_dir).select("graph", "id", "u", "v", "length"), 400.0).select("graph", "id")


@query("ways", sql="""WITH j AS (SELECT ref FROM ways GROUP BY ref HAVING count(*) >= 31), m AS (SELECT w.*, CASE WHEN j.ref IS NULL THEN 0 ELSE 1 END AS cut FROM ways w LEFT JOIN j USING (ref)),
  s AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM m), a AS (SELECT way, span, pos, ref FROM s UNION ALL SELECT way, span + 1, pos, ref FROM s WHERE cut = 1)
  SELECT way, CAST(span AS BIGINT) AS span, min(pos) AS first_pos, count(*) AS n FROM a GROUP BY way, span HAVING count(*) >= 2""")
def w13_split_ways(spark, sf_dir):
    """Ways cut at references that many ways share (the relational part of s5)."""
    w = rel.ways(spark, sf_dir)
    spans = G.split_at(w, w.groupBy("ref").agg(F.count("*").alias("n")).where("n >= 31"))
    return spans.groupBy("way", "span").agg(F.min("pos").cast("long").alias("first_pos"), F.count("*").alias("n"))


@query("ways", "nodes", sql="SELECT way, string_agg(ref, '-' ORDER BY pos) AS refs, count(*) AS n FROM ways JOIN nodes ON id = ref AND id % 11 <> 3 GROUP BY way")
def j2_resolved_refs(spark, sf_dir):
    got = rel.ways(spark, sf_dir).join(rel.nodes(spark, sf_dir).where("id % 11 <> 3"), F.col("ref") == F.col("id"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda p: p["ref"].cast("string"))
    return got.groupBy("way").agg(F.array_join(refs, "-").alias("refs"), F.count("*").alias("n"))


@query("nodes", sql="SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS d FROM nodes a JOIN nodes b ON a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 15")
def j14_close_pairs(spark, sf_dir):
    n = rel.nodes(spark, sf_dir)
    return J.near_by_place(n, 15.0).select("a", "b", r("d").alias("d"))


@query("segments", sql=f"WITH {LEN}, p AS (SELECT graph, least(u, v) AS a, greatest(u, v) AS b, id, bearing % 180 AS f FROM segs) SELECT p.graph, p.id AS first_id, q.id AS again_id FROM p JOIN p q ON p.graph = q.graph AND p.a = q.a AND p.b = q.b AND p.id < q.id AND abs(p.f - q.f) < 12")
def j15_duplicate_edges(spark, sf_dir):
    e = G.undirected(measured(spark, sf_dir)).select("graph", "a", "b", "id", F.pmod("bearing", F.lit(180.0)).alias("f"))
    o = e.select("graph", "a", "b", F.col("id").alias("again_id"), F.col("f").alias("g"))
    return e.join(o, ["graph", "a", "b"]).where((F.col("id") < F.col("again_id")) & (F.abs(F.col("f") - F.col("g")) < 12)).select("graph", F.col("id").alias("first_id"), "again_id")


@query("segments", sql="""WITH s AS (SELECT id // 16 AS way, id % 16 AS pos, ux, uy, vx, vy FROM segments), sd AS (SELECT a.way, a.pos AS p, b.pos AS q,
    (b.vx - b.ux) * (a.uy - b.uy) - (b.vy - b.uy) * (a.ux - b.ux) AS d1, (b.vx - b.ux) * (a.vy - b.uy) - (b.vy - b.uy) * (a.vx - b.ux) AS d2,
    (a.vx - a.ux) * (b.uy - a.uy) - (a.vy - a.uy) * (b.ux - a.ux) AS d3, (a.vx - a.ux) * (b.vy - a.uy) - (a.vy - a.uy) * (b.vx - a.ux) AS d4 FROM s a JOIN s b ON a.way = b.way AND b.pos >= a.pos + 2)
  SELECT way, count(*) AS crossings FROM sd WHERE (d1 > 0) <> (d2 > 0) AND (d3 > 0) <> (d4 > 0) GROUP BY way""")
def gr22_self_crossings(spark, sf_dir):
    s = rel.segments(spark, sf_dir).select(F.floor(F.col("id") / 16).alias("way"), (F.col("id") % 16).alias("pos"), "ux", "uy", "vx", "vy")
    o = s.toDF("way", "q", "ax", "ay", "bx", "by")
    both = s.join(o, "way").where("q >= pos + 2")
    cross = geo.segments_cross(tuple(map(F.col, ("ux", "uy", "vx", "vy"))), tuple(map(F.col, ("ax", "ay", "bx", "by"))))
    return both.where(cross).groupBy("way").agg(F.count("*").alias("crossings"))


@query("segments", sql="""SELECT id, round(CASE WHEN l > 0 THEN sqrt(pow(px - (ux + t * (vx - ux)), 2) + pow(py - (uy + t * (vy - uy)), 2)) ELSE sqrt(pow(px - ux, 2) + pow(py - uy, 2)) END, 4) AS d
  FROM (SELECT *, CASE WHEN l > 0 THEN greatest(0, least(1, ((px - ux) * (vx - ux) + (py - uy) * (vy - uy)) / l)) ELSE 0 END AS t FROM (SELECT *, (id % 1000)::DOUBLE AS px, (id * 7 % 1000)::DOUBLE AS py, pow(vx - ux, 2) + pow(vy - uy, 2) AS l FROM segments))""")
def m9_point_segment_distance(spark, sf_dir):
    s = rel.segments(spark, sf_dir).withColumns({"px": (F.col("id") % 1000).cast("double"), "py": (F.col("id") * 7 % 1000).cast("double")})
    return s.select("id", r(geo.point_segment_distance(*map(F.col, ("px", "py", "ux", "uy", "vx", "vy")))).alias("d"))


@query("segments", "tiles", sql=f"""WITH {LEN}, m AS (SELECT *, (ux + vx) / 2 AS mx, (uy + vy) / 2 AS my FROM segs) SELECT t.tile, count(*) AS edges, round(sum(length), 2) AS length FROM m JOIN tiles t
  ON mx >= t.ix * 200 AND mx < (t.ix + 1) * 200 AND my >= t.iy * 200 AND my < (t.iy + 1) * 200 GROUP BY t.tile""")
def gr4_core_edges(spark, sf_dir):
    """Edges by the tile that holds their midpoint: an equi join on the tile's index."""
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / 200).cast("int")
    e = measured(spark, sf_dir).withColumns({"ix": mid("ux", "vx"), "iy": mid("uy", "vy")})
    return e.join(rel.tiles(spark, sf_dir), ["ix", "iy"]).groupBy("tile").agg(F.count("*").alias("edges"), r(F.sum("length"), 2).alias("length"))


@query("segments", "tiles", sql="""SELECT t.tile, count(*) AS edges FROM segments s JOIN tiles t ON greatest(ux, vx) >= t.ix * 200 - 50 AND least(ux, vx) <= (t.ix + 1) * 200 + 50
  AND greatest(uy, vy) >= t.iy * 200 - 50 AND least(uy, vy) <= (t.iy + 1) * 200 + 50 GROUP BY t.tile""")
def j3_clip_edges(spark, sf_dir):
    """Whole edges that touch a tile's read extent."""
    s = rel.segments(spark, sf_dir)
    box = (F.least("ux", "vx"), F.least("uy", "vy"), F.greatest("ux", "vx"), F.greatest("uy", "vy"))
    return J.join_tiles(s, box, J.with_core(rel.tiles(spark, sf_dir), 200.0, 50.0), 200.0, 50.0, geo.touches).groupBy("tile").agg(F.count("*").alias("edges"))


@query("edges", sql="SELECT graph, id, u FROM (SELECT graph, id, u, row_number() OVER (PARTITION BY id ORDER BY src) AS k FROM (SELECT 0 AS src, graph, id, u FROM edges WHERE id % 3 = 0 UNION ALL SELECT 1, graph + 100, id, u + 1 FROM edges WHERE id % 2 = 0)) WHERE k = 1")
def j22_merge_first_wins(spark, sf_dir):
    """Union of graphs in which the first to hold an id wins (u1): a minimum over the source's order, then over what it holds.

    Ids repeat within a source where a way has more than 17 references; the SQL leaves open which row wins there.
    """
    e = rel.edges(spark, sf_dir)
    both = e.where("id % 3 = 0").select(F.lit(0).alias("src"), "graph", "id", "u").unionByName(e.where("id % 2 = 0").select(F.lit(1).alias("src"), (F.col("graph") + 100).alias("graph"), "id", (F.col("u") + 1).alias("u")))
    return both.groupBy("id").agg(F.min(F.struct("src", "graph", "u")).alias("w")).select("w.graph", "id", "w.u")


@query("edges", sql="SELECT road_class, rank, min_lod FROM " + CLASS_SQL + " WHERE road_class <> 'path'")
def p9_vehicular(spark, sf_dir):
    return dims.road_classes(spark).where("road_class <> 'path'").select("road_class", "rank", "min_lod")


@query("segments", "points", sql=f"""WITH {LEN}, e AS (SELECT id, graph, length, 100 * abs(a.z - b.z) / nullif(length, 0) AS grade FROM segs s JOIN (SELECT p_partkey AS k, (p_partkey * 13 % 40)::DOUBLE AS z FROM part) a ON a.k = s.u
  JOIN (SELECT p_partkey AS k, (p_partkey * 13 % 40)::DOUBLE AS z FROM part) b ON b.k = s.v) SELECT graph, count(*) FILTER (grade > 12) AS over_limit, round(max(grade), 3) AS steepest FROM e WHERE grade IS NOT NULL GROUP BY graph""")
def gr20_grades(spark, sf_dir):
    """Grade of each edge from its nodes' heights, and what is over the limit (gr19's report)."""
    z = rel.nodes(spark, sf_dir).select("id", (F.col("id") * 13 % 40).cast("double").alias("z"))
    e = measured(spark, sf_dir).join(z.toDF("u", "zu"), "u").join(z.toDF("v", "zv"), "v")
    e = e.withColumn("grade", 100 * F.abs(F.col("zu") - F.col("zv")) / F.nullif(F.col("length"), F.lit(0.0))).where("grade is not null")
    return e.groupBy("graph").agg(F.count_if(F.col("grade") > 12).alias("over_limit"), r(F.max("grade"), 3).alias("steepest"))
