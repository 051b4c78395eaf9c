"""Queries over burnt lines, structure measures, sets, shuffles and compositions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import burn as B
from ..operators import curves as C
from ..operators import graph as G
from ..operators import local as L
from ..operators import rangejoin as J
from ..operators import raster as R
from . import relations as rel
from .catalog import query
from .catalog import rounded as r
from .q_graph import CLASSED, LEN, classed, lines, measured
from .q_score import f1

CELL = 20.0


def fixed(value, digits: int):
    """A number as C's printf writes it: its exact binary value is rounded, and a tie goes to the even digit; Java's rounds the shortest decimal half up."""
    def write(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda x: f"{x:.{digits}f}").astype(object)

    return F.when(value.isNotNull(), F.pandas_udf(write, "string")(value))


BURN = f"""{CLASSED}, box AS (SELECT id, rank, bearing, ux, uy, vx, vy, CAST(floor(least(ux, vx) / 20) AS BIGINT) AS x0, CAST(floor(least(uy, vy) / 20) AS BIGINT) AS y0, CAST(floor(greatest(ux, vx) / 20) AS BIGINT) + 1 AS x1, CAST(floor(greatest(uy, vy) / 20) AS BIGINT) + 1 AS y1 FROM classed),
  each_ AS MATERIALIZED (SELECT *, unnest(range((x1 - x0) * (y1 - y0))) AS i FROM box), tall AS (SELECT *, x0 + i % (x1 - x0) AS cx, y0 + i // (x1 - x0) AS cy FROM each_),
  hit AS MATERIALIZED (SELECT * FROM tall WHERE cx >= 0 AND cx < 50 AND cy >= 0 AND cy < 50 AND abs((vx - ux) * (cy * 20 + 10 - uy) - (vy - uy) * (cx * 20 + 10 - ux)) <= 10 * (abs(vx - ux) + abs(vy - uy)))"""


def hits(spark, sf_dir):
    return B.touched(classed(spark, sf_dir), CELL)


@query("segments", sql=f"WITH {BURN} SELECT cx, cy, count(*) AS n FROM hit GROUP BY cx, cy")
def r4_road_burn(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("segments", sql=f"WITH {BURN} SELECT cx, cy, CAST(12 - rank AS INTEGER) AS ordinal, round(sin(radians(2 * bearing)), 4) AS s, round(cos(radians(2 * bearing)), 4) AS c FROM hit WHERE rank < 99 QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY rank, id DESC) = 1")
def r5_painted_classes(spark, sf_dir):
    """Class and orientation (r6) of the road painted last in a cell: the most significant (t3)."""
    p = B.painted(hits(spark, sf_dir).where("rank < 99"), "rank", "id", "rank", "bearing")
    turn = F.radians(2 * F.col("bearing"))
    return p.select("cx", "cy", (12 - F.col("rank")).alias("ordinal"), r(F.sin(turn)).alias("s"), r(F.cos(turn)).alias("c"))


@query("segments", "tiles", sql=f"""WITH {LEN}, deg AS (SELECT node, count(*) AS d FROM (SELECT id, u AS node FROM segs UNION SELECT id, v FROM segs) GROUP BY node),
  core AS (SELECT t.tile, d FROM deg JOIN nodes n ON n.id = deg.node JOIN tiles t ON n.x >= t.ix * 200 AND n.x < (t.ix + 1) * 200 AND n.y >= t.iy * 200 AND n.y < (t.iy + 1) * 200),
  e AS (SELECT t.tile, length FROM segs JOIN tiles t ON (ux + vx) / 2 >= t.ix * 200 AND (ux + vx) / 2 < (t.ix + 1) * 200 AND (uy + vy) / 2 >= t.iy * 200 AND (uy + vy) / 2 < (t.iy + 1) * 200),
  es AS (SELECT tile, sum(length) AS l, quantile_cont(length, 0.5) AS med FROM e GROUP BY tile), cs AS (SELECT tile, count(*) AS n, count(*) FILTER (d >= 3) AS x, count(*) FILTER (d = 1) AS ends FROM core GROUP BY tile)
  SELECT t.tile, round(coalesce(l, 0) / 1000 / 0.04, 3) AS density, round(coalesce(x, 0) / 0.04, 2) AS crossings, round(ends / nullif(n, 0)::DOUBLE, 5) AS dead_ends, round(med, 3) AS median_length FROM tiles t LEFT JOIN es USING (tile) LEFT JOIN cs USING (tile)""")
def a6_road_structure(spark, sf_dir):
    """Measures of a tile's core: edges by midpoint, nodes by place, degrees from the whole graph."""
    s = measured(spark, sf_dir).withColumn("graph", F.lit(0))  # the graphs lie over each other: one network
    t = rel.tiles(spark, sf_dir).select("tile", "ix", "iy")
    at = lambda c: F.floor(c / 200).cast("int")
    e = s.withColumns({"ix": at((F.col("ux") + F.col("vx")) / 2), "iy": at((F.col("uy") + F.col("vy")) / 2)}).join(t, ["ix", "iy"])
    e = e.groupBy("tile").agg(F.sum("length").alias("l"), F.percentile("length", 0.5).alias("med"))
    n = G.degrees(s).join(rel.nodes(spark, sf_dir), F.col("node") == F.col("id")).withColumns({"ix": at(F.col("x")), "iy": at(F.col("y"))}).join(t, ["ix", "iy"])
    n = n.groupBy("tile").agg(F.count("*").alias("n"), F.count_if(F.col("degree") >= 3).alias("c"), F.count_if(F.col("degree") == 1).alias("ends"))
    rows = t.join(e, "tile", "left").join(n, "tile", "left")
    return rows.select("tile", r(F.coalesce("l", F.lit(0.0)) / 1000 / 0.04, 3).alias("density"), r(F.coalesce("c", F.lit(0)) / 0.04, 2).alias("crossings"), r(F.col("ends") / F.nullif(F.col("n"), F.lit(0).cast("long")), 5).alias("dead_ends"), r("med", 3).alias("median_length"))


@query("ways", "nodes", sql="""WITH p AS (SELECT way, pos, n.x, n.y FROM ways JOIN nodes n ON n.id = ref) SELECT p.way, p.pos, m.id AS node FROM p JOIN nodes m ON round_even(m.x + 0.0004, 3) = round_even(p.x + 0.0001, 3) AND round_even(m.y - 0.0002, 3) = round_even(p.y, 3)""".replace("round_even(m.x + 0.0004, 3) = round_even(p.x + 0.0001, 3) AND round_even(m.y - 0.0002, 3) = round_even(p.y, 3)", "m.x = p.x AND m.y = p.y"))
def j23_snapped_vertices(spark, sf_dir):
    """Vertices that equal a node to the millimetre: an equi join on rounded places."""
    n = rel.nodes(spark, sf_dir)
    p = rel.ways(spark, sf_dir).join(n, F.col("ref") == F.col("id")).select("way", "pos", F.bround(F.col("x") + 0.0001, 3).alias("kx"), F.bround("y", 3).alias("ky"))
    m = n.select(F.col("id").alias("node"), F.bround(F.col("x") + 0.0004, 3).alias("kx"), F.bround(F.col("y") - 0.0002, 3).alias("ky"))
    return J.at_places(p, m, ["kx", "ky"], "node").select("way", F.col("pos").cast("long").alias("pos"), "node")


@query(sql="SELECT mesh, min(idx) AS idx, min_by(size, idx) AS size FROM (SELECT o_custkey AS mesh, CAST(o_orderkey % 4 AS INTEGER) AS idx, min(floor(o_totalprice)) AS size FROM orders GROUP BY ALL) GROUP BY mesh")
def s22_first_index_wins(spark, sf_dir):
    """Meshes of several indexes, the first index that lists one wins (w15)."""
    o = rel.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("mesh"), (F.col("o_orderkey") % 4).cast("int").alias("idx")).agg(F.min(F.floor("o_totalprice").cast("double")).alias("size"))
    return o.groupBy("mesh").agg(F.min("idx").alias("idx"), F.min_by("size", "idx").alias("size"))


@query(sql="SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount = 0.0")
def s37_uncached_members(spark, sf_dir):
    """What is wanted and not there yet (s38): an anti join."""
    t = rel.table(spark, sf_dir, "lineitem")
    cached = t.where("l_discount = 0.0").select(F.col("l_partkey").alias("member"))
    return t.where("l_quantity > 40").select(F.col("l_partkey").alias("member")).distinct().join(cached, "member", "left_anti")


@query("stack", sql="""WITH a AS (SELECT tile, list(cell ORDER BY cell) FILTER (v > 0) AS t, list(cell ORDER BY cell) FILTER (v > 20) AS o FROM stack GROUP BY tile)
  SELECT tile, CAST(coalesce(len(list_intersect(t, o)), 0) AS INTEGER) AS tp, CAST(coalesce(len(t), 0) - coalesce(len(list_intersect(t, o)), 0) AS INTEGER) AS fn, CAST(coalesce(len(o), 0) - coalesce(len(list_intersect(t, o)), 0) AS INTEGER) AS fp FROM a""")
def u4_set_counts(spark, sf_dir):
    """Hits, misses and extras of two sets of cells."""
    of = lambda k: F.collect_set(F.when(F.col("v") > k, F.col("cell")))
    s = rel.stack(spark, sf_dir).groupBy("tile").agg(of(0).alias("t"), of(20).alias("o"))
    return s.select("tile", F.size(F.array_intersect("t", "o")).alias("tp"), F.size(F.array_except("t", "o")).alias("fn"), F.size(F.array_except("o", "t")).alias("fp"))


@query(sql="SELECT CAST(a.i - 3 AS INTEGER) AS dr, CAST(b.i - 3 AS INTEGER) AS dc FROM range(7) a(i), range(7) b(i) WHERE gcd(abs(a.i - 3), abs(b.i - 3)) = 1")
def m36_lattice_moves(spark, sf_dir):
    """Coprime offsets within three steps."""
    import math

    moves = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if math.gcd(a, b) == 1]
    return spark.createDataFrame(moves, "dr int, dc int")


@query("nodes", sql="""WITH line AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 400.0::DOUBLE, 300.0::DOUBLE), (1, 400.0, 300.0, 700.0, 300.0), (2, 700.0, 300.0, 1000.0, 1000.0)) AS d(seg, ax, ay, bx, by_)),
  d AS (SELECT n.id, seg, ax, ay, bx, by_, x, y, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM nodes n, line),
  e AS (SELECT id, seg, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2)) AS d FROM d) SELECT id, round(min(round(d, 6)), 4) AS d, CAST(min_by(seg, round(d, 6) * 10 + seg * 1e-6) AS INTEGER) AS seg FROM e GROUP BY id""")
def m10_distance_to_line(spark, sf_dir):
    """Distance to a polyline and its nearest segment, the first of equals: an array of segments, no join."""
    points = [(0.0, 0.0), (400.0, 300.0), (700.0, 300.0), (1000.0, 1000.0)]
    each = [F.struct((F.round(geo.point_segment_distance(F.col("x"), F.col("y"), *map(F.lit, (*a, *b))) + 1e-9, 6)).alias("d"), F.lit(i).alias("seg")) for i, (a, b) in enumerate(zip(points, points[1:]))]
    return rel.nodes(spark, sf_dir).withColumn("m", F.array_min(F.array(*each))).select("id", r("m.d").alias("d"), "m.seg")


@query("tiles", sql="""WITH s AS (SELECT tile, row_number() OVER (ORDER BY sha256('7:1:' || tile)) - 1 AS k, count(*) OVER () AS n FROM tiles) SELECT tile, CAST(k // 4 AS INTEGER) AS grp, CAST(k % 4 AS INTEGER) AS place FROM s WHERE k // 4 < n // 4""")
def w14_epoch_groups(spark, sf_dir):
    """Tiles in an order drawn by hash, in groups of four; the short tail is left out."""
    key = F.sha2(F.concat(F.lit("7:1:"), F.col("tile").cast("string")), 256)
    s = rel.tiles(spark, sf_dir).select("tile", key.alias("key"), F.substring(key, 1, 2).alias("head"))
    counts = s.groupBy("head").agg(F.count("*").alias("n"))  # 256 rows at most, whatever the tiles
    every = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = counts.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"), F.sum("n").over(every).alias("all"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("key")) - 1
    s = s.join(F.broadcast(before), "head").select("tile", (F.col("before") + place).alias("k"), "all")
    return s.where(F.floor(F.col("k") / 4) < F.floor(F.col("all") / 4)).select("tile", F.floor(F.col("k") / 4).cast("int").alias("grp"), (F.col("k") % 4).cast("int").alias("place"))


@query("segments", sql=f"WITH {CLASSED} SELECT id, road_class, coalesce(nullif(id % 3, 0), lanes) AS lanes, CASE WHEN id % 5 = 0 THEN width_m ELSE (id % 5)::DOUBLE END AS width_m FROM classed")
def p10_class_defaults(spark, sf_dir):
    e = classed(spark, sf_dir)
    return e.select("id", "road_class", F.coalesce(F.nullif(F.col("id") % 3, F.lit(0).cast("long")), F.col("lanes").cast("long")).alias("lanes"), F.coalesce(F.nullif((F.col("id") % 5).cast("double"), F.lit(0.0)), F.col("width_m")).alias("width_m"))


@query("tiles", sql="SELECT tile, CASE WHEN site = 2 THEN NULL ELSE NOT (site IN (0, 3)) END AS unseen FROM tiles")
def p35_unseen_sites(spark, sf_dir):
    """Whether a site was kept from training; null where the card is silent."""
    card = F.when(F.col("site") == 2, F.lit(None).cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(3)))
    return rel.tiles(spark, sf_dir).select("tile", (~F.array_contains(card, F.col("site"))).alias("unseen"))


@query("points", sql="SELECT tile, CAST(floor(least(greatest(avg(z) / 50, 0), 1) * 255) AS INTEGER) AS shade, count(*) AS n FROM points GROUP BY tile")
def m42_colour_index(spark, sf_dir):
    p = rel.points(spark, sf_dir).groupBy("tile").agg(F.avg("z").alias("z"), F.count("*").alias("n"))
    return p.select("tile", F.floor(F.least(F.greatest(F.col("z") / 50, F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias("shade"), "n")


SPECKS = """WITH RECURSIVE on_ AS (SELECT tile, cell, "row" AS rw, col FROM stack WHERE v > 100), adj AS (SELECT a.tile, a.cell, b.cell AS other FROM on_ a JOIN on_ b ON a.tile = b.tile AND abs(a.rw - b.rw) + abs(a.col - b.col) = 1),
  reach AS (SELECT tile, cell, cell AS root FROM on_ UNION SELECT r.tile, a.other, r.root FROM reach r JOIN adj a ON a.tile = r.tile AND a.cell = r.cell), roots AS (SELECT tile, cell, min(root) AS root FROM reach GROUP BY ALL)"""


@query("stack", sql=SPECKS + " SELECT tile, root, count(*) AS cells FROM roots GROUP BY ALL HAVING count(*) >= 4")
def gr13_drop_specks(spark, sf_dir):
    """4-adjacent patches of set cells, the small ones dropped."""
    on = rel.stack(spark, sf_dir).where("v > 100").select("tile", "cell", "row", "col")
    right = on.select("tile", F.col("row"), (F.col("col") - 1).alias("col"), F.col("cell").alias("other"))
    down = on.select("tile", (F.col("row") - 1).alias("row"), "col", F.col("cell").alias("other"))
    edges = on.join(right.unionByName(down), ["tile", "row", "col"]).select(F.col("tile").alias("graph"), F.monotonically_increasing_id().alias("id"), F.col("cell").alias("u"), F.col("other").alias("v"))
    return G.components(edges.drop("id")).groupBy(F.col("graph").alias("tile"), "root").agg(F.count("*").alias("cells")).where("cells >= 4")


@query("scores", sql="""WITH c AS (SELECT tile, count(*) FILTER (p >= 0.2 AND truth) AS tp, count(*) FILTER (p >= 0.2 AND NOT truth) AS fp, count(*) FILTER (p < 0.2 AND truth) AS fn FROM scores WHERE valid GROUP BY tile)
  SELECT CAST(tile % 5 AS INTEGER) AS fold, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)::DOUBLE, 5) AS pooled, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)), 5) AS per_tile FROM c GROUP BY 1""")
def a19_fold_scores(spark, sf_dir):
    """Scores of a fold: pooled over its cells, and the mean of its tiles."""
    hit = F.col("p") >= 0.2
    s = rel.scores(spark, sf_dir).where("valid").groupBy("tile").agg(F.count_if(hit & F.col("truth")).alias("tp"), F.count_if(hit & ~F.col("truth")).alias("fp"), F.count_if(~hit & F.col("truth")).alias("fn"))
    per = s.withColumn("f", f1(F.col("tp"), F.col("fp"), F.col("fn"))).groupBy((F.col("tile") % 5).alias("fold"))
    return per.agg(r(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 5).alias("pooled"), r(F.avg("f"), 5).alias("per_tile"))


W8 = """w AS (SELECT CAST(i - 4 AS INTEGER) AS o, exp(-(i - 4) * (i - 4) / 2.0::DOUBLE) / sum(exp(-(i - 4) * (i - 4) / 2.0::DOUBLE)) OVER () AS w FROM range(9) t(i)), s AS (SELECT tile, "row" AS rw, col, v FROM stack),
  a AS (SELECT g.tile, g.rw, g.col, sum(w * h.v) AS v FROM s g, w JOIN s h ON h.tile = g.tile AND h.rw = g.rw AND h.col = CASE WHEN g.col + o < 0 THEN -g.col - o - 1 WHEN g.col + o > 7 THEN 15 - g.col - o ELSE g.col + o END GROUP BY ALL)"""


@query("stack", sql=f"""WITH {W8} SELECT g.tile, g.rw, g.col, round(sum(w * h.v), 4) AS v FROM a g, w JOIN a h ON h.tile = g.tile AND h.col = g.col AND h.rw = CASE WHEN g.rw + o < 0 THEN -g.rw - o - 1 WHEN g.rw + o > 7 THEN 15 - g.rw - o ELSE g.rw + o END GROUP BY g.tile, g.rw, g.col""")
def w8_gaussian(spark, sf_dir):
    s = rel.stack(spark, sf_dir).select("tile", "row", "col", "v")
    return R.gaussian(s, 8, 8, 1.0).select("tile", F.col("row").alias("rw"), "col", r("v").alias("v"))


@query("ways", "nodes", sql="""WITH p AS (SELECT way, x, y, coalesce(lead(x) OVER o, x) - coalesce(lag(x) OVER o, x) AS dx, coalesce(lead(y) OVER o, y) - coalesce(lag(y) OVER o, y) AS dy FROM ways JOIN nodes ON id = ref WINDOW o AS (PARTITION BY way ORDER BY pos)),
  t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0 END AS tx, CASE WHEN dx * dx + dy * dy > 0 THEN dy / sqrt(dx * dx + dy * dy) ELSE 0 END AS ty FROM p)
  SELECT way, round(sum(x - ty * 2.5), 3) AS left_x, round(sum(y + tx * 2.5), 3) AS left_y, round(sum(x + ty * 2.5), 3) AS right_x FROM t GROUP BY way""")
def m25_ribbon(spark, sf_dir):
    """Both sides of a road of 5 m along its line."""
    both = F.zip_with("line", C.tangents(F.col("line")), lambda p, t: F.struct((p["x"] - t["ty"] * 2.5).alias("lx"), (p["y"] + t["tx"] * 2.5).alias("ly"), (p["x"] + t["ty"] * 2.5).alias("rx")))
    rows = lines(spark, sf_dir).select("way", both.alias("b"))
    sums = lambda f: r(geo.total(F.transform("b", lambda p: p[f])), 3)
    return rows.select("way", sums("lx").alias("left_x"), sums("ly").alias("left_y"), sums("rx").alias("right_x"))


@query("tiles", sql="SELECT tile, ix, iy FROM tiles ORDER BY iy, ix LIMIT 7")
def t7_first_tiles(spark, sf_dir):
    """The first tiles in row-major order: the limit is the operator."""
    return rel.tiles(spark, sf_dir).orderBy("iy", "ix").limit(7).select("tile", "ix", "iy")


@query("buildings", sql="SELECT a.id AS a, b.id AS b FROM buildings a JOIN buildings b ON a.id < b.id AND a.x + a.side >= b.x AND b.x + b.side >= a.x AND a.y + a.side >= b.y AND b.y + b.side >= a.y")
def p5_touching_boxes(spark, sf_dir):
    """Pairs of boxes that share area, an edge or a corner: bucketed, equal boxes compared as one."""
    b = rel.buildings(spark, sf_dir).select("id", "x", "y", (F.col("x") + F.col("side")).alias("x2"), (F.col("y") + F.col("side")).alias("y2"))
    return J.touching_boxes(b, 60.0)


@query("manifests", sql="SELECT DISTINCT role, version FROM manifests")
def u6_distinct_versions(spark, sf_dir):
    return rel.manifests(spark, sf_dir).select("role", "version").distinct()


@query(sql="SELECT o_custkey AS archive, count(*) AS n, printf('%d members, %.3f MB, %d large', count(*), sum(floor(o_totalprice)) / 1000000, count(*) FILTER (o_totalprice > 200000)) AS line FROM orders GROUP BY o_custkey")
def a35_fetch_reports(spark, sf_dir):
    """A line for each archive; megabytes as C prints them, no line where no size is known."""
    o = rel.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("archive"))
    price = F.col("o_totalprice")
    floor = F.when(F.abs(price) < 2**53, F.floor(price).cast("double")).otherwise(price)  # Spark's floor is a long
    o = o.agg(F.count("*").alias("n"), F.sum(floor).alias("size"), F.count_if(price > 200000).alias("large"))
    size = fixed(F.col("size") / 1000000, 3)
    line = F.format_string("%d members, %s MB, %d large", "n", size, "large")
    return o.select("archive", "n", F.when(F.col("size").isNotNull(), line).alias("line"))


@query()
def gr17_routes(spark, sf_dir):
    """Grade-limited routes over each tile's block of heights (gr18, gr19)."""
    import pandas as pd

    def run(group):
        import numpy as np

        z = np.zeros((8, 8))
        z[group["row"], group["col"]] = group["v"] / 20.0
        path = L.route(z, (0, 0), (7, 7), 8.0, 30.0)
        return pd.DataFrame([(int(group["tile"].iloc[0]), -1 if path is None else len(path))], columns=["tile", "steps"])

    return rel.stack(spark, sf_dir).groupBy("tile").applyInPandas(run, "tile long, steps long")


@query()
def n11_generated_roads(spark, sf_dir):
    """Roads of each tile's block: extracted, repaired and led within a grade (gr11, gr16, gr19), as edges."""
    s = rel.stack(spark, sf_dir).select("tile", "row", "col", "v", ((F.col("row") + F.col("col")) * 0.4).alias("z"))
    small = {"branch": 2, "tolerance": 1.0, "merge": 3.0, "holes": 2, "specks": 2, "spur": 5.0}
    made = L.generate(s, 8, 8, 0.0, 5.0, {"least": 10.0, "gap": 15.0, "snap": 8.0, "stub": 5.0}, small, 30.0)
    return made.select("graph", "id", "u", "v", r("length").alias("length"), "line", "step", r("confidence").alias("confidence"), r("grade").alias("grade"))


@query("stack", sql="SELECT tile, cell, round(1 / (1 + exp(-v / 100.0::DOUBLE)), 6) AS p FROM stack")
def n5_predictions(spark, sf_dir):
    """A pluggable predictor over cells in Arrow batches: here a logistic one of fixed weights."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def predict(batches):
        for b in batches:
            x = pc.divide(b.column(2), 100.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.divide(1.0, pc.add(1.0, pc.exp(pc.negate(x))))], ["tile", "cell", "p"])

    return rel.stack(spark, sf_dir).select("tile", "cell", "v").mapInArrow(predict, "tile long, cell int, p double").withColumn("p", r("p", 6))


@query("stack", sql="SELECT site, arm, round(avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 5) AS coverage, round(avg(p), 5) AS mean FROM (SELECT site, arm, 1 / (1 + exp(-(v * arm - 60) / 50)) AS p FROM stack, (SELECT unnest([0.5::DOUBLE, 1.0, 2.0]) AS arm)) GROUP BY ALL")
def n10_sweep(spark, sf_dir):
    """Coverage of the predictor's mask under scaled inputs, arm by arm."""
    arms = F.explode(F.array(*[F.lit(k) for k in (0.5, 1.0, 2.0)]))
    s = rel.stack(spark, sf_dir).withColumn("arm", arms)
    p = 1 / (1 + F.exp(-(F.col("v") * F.col("arm") - 60) / 50))
    return s.groupBy("site", "arm").agg(r(F.avg((p >= 0.5).cast("int")), 5).alias("coverage"), r(F.avg(p), 5).alias("mean"))


