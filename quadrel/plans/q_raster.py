"""Queries over grids: gridding, terrain, windows, normalisation, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import raster as R
from . import relations as rel
from .catalog import query
from .catalog import rounded as r

N = 33
DEM = """dem AS (SELECT tile, "row", col, avg(z) AS z FROM (SELECT tile, z, CAST(floor(33 - y) AS INTEGER) AS "row", CAST(floor(x) AS INTEGER) AS col FROM points)
    WHERE "row" BETWEEN 0 AND 32 GROUP BY tile, "row", col),
  grid AS (SELECT t.tile, CAST(r.i AS INTEGER) AS "row", CAST(c.i AS INTEGER) AS col, d.z FROM (SELECT DISTINCT tile FROM dem) t, range(33) r(i), range(33) c(i)
    LEFT JOIN dem d ON d.tile = t.tile AND d."row" = r.i AND d.col = c.i)"""
HORN = DEM + """,
  n AS (SELECT g.tile, g."row", g.col, g.z, o.dr, o.dc, h.z AS nz FROM grid g, (SELECT a.i - 1 AS dr, b.i - 1 AS dc FROM range(3) a(i), range(3) b(i)) o
    JOIN grid h ON h.tile = g.tile AND h."row" = least(greatest(g."row" + o.dr, 0), 32) AND h.col = least(greatest(g.col + o.dc, 0), 32)),
  horn AS (SELECT tile, "row", col, any_value(z) AS z,
      CASE WHEN count(z) = 9 AND count(nz) FILTER (dc <> 0) = 6 THEN sum(nz * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / 8.0::DOUBLE END AS dzdx,
      CASE WHEN count(z) = 9 AND count(nz) FILTER (dr <> 0) = 6 THEN -sum(nz * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / 8.0::DOUBLE END AS dzdy FROM n GROUP BY ALL HAVING true)"""
HORN = HORN.replace(' FROM n GROUP BY ALL HAVING true', ' FROM n GROUP BY tile, "row", col')


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grid_mean(rel.points(spark, sf_dir), 0.0, 0.0, N, N)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense(dem(spark, sf_dir), N, N)


def horn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.horn(grid(spark, sf_dir))


@query("points", sql=f'WITH {DEM} SELECT tile, "row", col, round(z, 4) AS z FROM dem')
def a1_grid_mean(spark, sf_dir):
    return dem(spark, sf_dir).withColumn("z", r("z"))


@query("points", sql="""SELECT tile, "row", col, round(avg(z), 4) AS z FROM (SELECT tile, z, CAST(least(greatest(floor((33 - y) / 2), 0), 15) AS INTEGER) AS "row",
  CAST(least(greatest(floor(x / 2), 0), 15) AS INTEGER) AS col FROM points WHERE x >= 0 AND x < 33 AND y >= 0 AND y < 33) GROUP BY ALL""")
def s28_accumulate(spark, sf_dir):
    p = rel.points(spark, sf_dir).where("x >= 0 and x < 33 and y >= 0 and y < 33")
    at = lambda v: F.least(F.greatest(F.floor(v / 2), F.lit(0)), F.lit(15)).cast("int")
    return p.groupBy("tile", at(33 - F.col("y")).alias("row"), at(F.col("x")).alias("col")).agg(r(F.avg("z")).alias("z"))


@query("points", sql="""SELECT tile, count(*) AS n, sum(z) AS z FROM (SELECT *, max(CASE WHEN cls = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY tile) AS has FROM points)
  WHERE has = 0 OR cls = 2 GROUP BY tile""")
def s18_ground_points(spark, sf_dir):
    """Ground returns of a tile, or all where it has none; the fallback needs one flag a tile, not its points."""
    p = rel.points(spark, sf_dir)
    bare = p.groupBy("tile").agg(F.max((F.col("cls") == 2).cast("int")).alias("any")).where("any = 0").select("tile")
    return p.where("cls = 2").unionByName(p.join(bare, "tile", "left_semi")).groupBy("tile").agg(F.count("*").alias("n"), F.sum("z").alias("z"))


@query("points", sql="""SELECT tile, "row", col, round(max_by(z, cls), 4) AS z FROM (SELECT tile, cls, CAST(floor(33 - y) AS INTEGER) AS "row", CAST(floor(x) AS INTEGER) AS col, avg(z) AS z
  FROM points GROUP BY ALL) WHERE "row" BETWEEN 0 AND 32 GROUP BY ALL""")
def s27_later_mesh_wins(spark, sf_dir):
    p = rel.points(spark, sf_dir)
    by_mesh = p.groupBy("tile", "cls", F.floor(33 - F.col("y")).cast("int").alias("row"), F.floor("x").cast("int").alias("col")).agg(F.avg("z").alias("z"))
    return by_mesh.where(F.col("row").between(0, 32)).groupBy("tile", "row", "col").agg(r(F.max_by("z", "cls")).alias("z"))


@query("points", sql=f"WITH {DEM} SELECT tile, round(count(z) / count(*)::DOUBLE, 6) AS coverage FROM grid GROUP BY tile")
def a2_coverage(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("tile").agg(r(F.avg(F.col("z").isNotNull().cast("int")), 6).alias("coverage"))


@query("points", sql=f'WITH {DEM} SELECT tile, CAST("row" // 4 AS INTEGER) AS "row", CAST(col // 4 AS INTEGER) AS col, round(avg(z), 4) AS z FROM grid WHERE "row" < 32 AND col < 32 GROUP BY ALL')
def a3_downsample(spark, sf_dir):
    return R.downsample(grid(spark, sf_dir), 4, N, N).withColumn("z", r("z"))


@query("points", sql=f'WITH {HORN} SELECT tile, "row", col, round(dzdx, 4) AS dzdx, round(dzdy, 4) AS dzdy FROM horn WHERE dzdx IS NOT NULL OR dzdy IS NOT NULL')
def w2_horn(spark, sf_dir):
    return horn(spark, sf_dir).where("dzdx is not null or dzdy is not null").select("tile", "row", "col", r("dzdx").alias("dzdx"), r("dzdy").alias("dzdy"))


@query("points", sql=f"""WITH {HORN} SELECT tile, "row", col, round(100 * sqrt(dzdx * dzdx + dzdy * dzdy), 3) AS percent, round(degrees(atan(sqrt(dzdx * dzdx + dzdy * dzdy))), 4) AS angle
  FROM horn WHERE dzdx IS NOT NULL AND dzdy IS NOT NULL""")
def m28_slope(spark, sf_dir):
    g = horn(spark, sf_dir).where("dzdx is not null and dzdy is not null")
    return g.select("tile", "row", "col", r(R.slope_percent(F.col("dzdx"), F.col("dzdy")), 3).alias("percent"), r(R.slope_degrees(F.col("dzdx"), F.col("dzdy"))).alias("angle"))


@query("points", sql=f"""WITH {HORN} SELECT tile, "row", col, round(CASE WHEN abs(dzdx) > 1e-8 OR abs(dzdy) > 1e-8 THEN (degrees(atan2(-dzdx, -dzdy)) + 360) % 360 END, 4) AS aspect
  FROM horn WHERE dzdx IS NOT NULL AND dzdy IS NOT NULL""")
def m29_aspect(spark, sf_dir):
    g = horn(spark, sf_dir).where("dzdx is not null and dzdy is not null")
    return g.select("tile", "row", "col", r(R.aspect(F.col("dzdx"), F.col("dzdy"))).alias("aspect"))


@query("points", sql=f"""WITH {HORN}, s AS (SELECT *, atan(sqrt(dzdx * dzdx + dzdy * dzdy)) AS s, atan2(-dzdx, -dzdy) AS a FROM horn WHERE dzdx IS NOT NULL AND dzdy IS NOT NULL)
  SELECT tile, "row", col, round(greatest(0::DOUBLE, least(255::DOUBLE, 255 * (cos(radians(45)) * cos(s) + sin(radians(45)) * sin(s) * cos(radians(315) - a)))), 3) AS shade FROM s""")
def m30_hillshade(spark, sf_dir):
    g = horn(spark, sf_dir).where("dzdx is not null and dzdy is not null")
    return g.select("tile", "row", "col", r(R.hillshade(F.col("dzdx"), F.col("dzdy")), 3).alias("shade"))


@query("points", sql=f"""WITH {HORN} SELECT tile, count(*) FILTER (coalesce(100 * sqrt(dzdx * dzdx + dzdy * dzdy), 0) > 500) AS steep, count(*) AS n FROM horn GROUP BY tile""")
def p18_exceeds_grade(spark, sf_dir):
    steep = F.coalesce(R.slope_percent(F.col("dzdx"), F.col("dzdy")), F.lit(0.0)) > 500
    return horn(spark, sf_dir).groupBy("tile").agg(F.count_if(steep).alias("steep"), F.count("*").alias("n"))


@query("points", sql=f"""WITH {DEM}, n AS (SELECT g.tile, g."row", g.col, any_value(g.z) AS z, count(h.z) AS n, sum(h.z) AS s, sum(h.z * h.z) AS q FROM grid g,
    (SELECT a.i - 1 AS dr, b.i - 1 AS dc FROM range(3) a(i), range(3) b(i)) o
    JOIN grid h ON h.tile = g.tile AND h."row" = least(greatest(g."row" + o.dr, 0), 32) AND h.col = least(greatest(g.col + o.dc, 0), 32) GROUP BY g.tile, g."row", g.col)
  SELECT tile, "row", col, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 3) AS roughness FROM n WHERE z IS NOT NULL""")
def w3_roughness(spark, sf_dir):
    return R.roughness(grid(spark, sf_dir), 1).where("z is not null").select("tile", "row", "col", r("roughness", 3).alias("roughness"))


@query("points", sql=f"""WITH {DEM} SELECT g.tile, g."row", g.col, round(coalesce(sum(h.z), 0), 3) AS total, count(h.z) AS n FROM grid g JOIN grid h ON h.tile = g.tile AND abs(h."row" - g."row") <= 2 AND abs(h.col - g.col) <= 2
  GROUP BY g.tile, g."row", g.col""")
def w4_box_sum(spark, sf_dir):
    s = R.box_sums(grid(spark, sf_dir), 2, total=F.coalesce("z", F.lit(0.0)), n=F.col("z").isNotNull().cast("long"))
    return s.select("tile", "row", "col", r("total", 3).alias("total"), "n")


@query("points", sql=f"""WITH {DEM} SELECT g.tile, g."row", g.col, round(least(1, greatest(0, 4 * avg(CASE WHEN h.z > 30 THEN 1.0::DOUBLE ELSE 0 END))), 4) AS prior
  FROM grid g JOIN grid h ON h.tile = g.tile AND abs(h."row" - g."row") <= 3 AND abs(h.col - g.col) <= 3 GROUP BY g.tile, g."row", g.col""")
def w5_proximity_prior(spark, sf_dir):
    built = F.when(F.col("z") > 30, 1.0).otherwise(0.0)
    s = R.box_sums(grid(spark, sf_dir), 3, on=built, cells=F.lit(1.0))
    return s.select("tile", "row", "col", r(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 4 * F.col("on") / F.col("cells")))).alias("prior"))


FILL = """, {b} AS (SELECT g.tile, g."row", g.col, coalesce(g.z, (SELECT avg(h.z) FROM {a} h WHERE h.tile = g.tile AND abs(h."row" - g."row") + abs(h.col - g.col) = 1)) AS z FROM {a} g)"""


@query("points", sql=f"""WITH {DEM}{FILL.format(a="grid", b="f1")}{FILL.format(a="f1", b="f2")} SELECT tile, "row", col, round(z, 3) AS z FROM f2""")
def w6_fill_gaps(spark, sf_dir):
    return R.fill_gaps(grid(spark, sf_dir), 2).select("tile", "row", "col", r("z", 3).alias("z"))


@query("points", sql=f"""WITH {DEM}, l AS (SELECT t.tile, CAST(a.i AS INTEGER) AS "row", CAST(b.i AS INTEGER) AS col FROM (SELECT DISTINCT tile FROM grid) t, range(25) a(i), range(25) b(i))
  SELECT l.tile, l."row", l.col, round(g.z, 4) AS z FROM l LEFT JOIN grid g ON g.tile = l.tile AND g."row" = floor((l."row" + 0.5) * 1.5) AND g.col = floor((l.col + 0.5) * 1.5)""")
def r8_align(spark, sf_dir):
    return R.resample(grid(spark, sf_dir), N, N, 1.0, 25, 25, 1.5).withColumn("z", r("z"))


@query("points", sql=f"""WITH {DEM} SELECT tile, CAST("row" - 4 AS INTEGER) AS "row", CAST(col - 7 AS INTEGER) AS col, round(z, 4) AS z FROM grid WHERE "row" BETWEEN 4 AND 19 AND col BETWEEN 7 AND 29""")
def r9_clip(spark, sf_dir):
    return R.clip(grid(spark, sf_dir), 4, 20, 7, 30).withColumn("z", r("z"))


@query("tiles", sql="""SELECT tile, CAST(a.i AS INTEGER) AS "row", CAST(b.i AS INTEGER) AS col, -1.0::DOUBLE AS v FROM tiles, range(6) a(i), range(9) b(i)""")
def r10_constant_raster(spark, sf_dir):
    lattice = rel.tiles(spark, sf_dir).select("tile", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("row"))
    return lattice.select("tile", "row", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("col"), F.lit(-1.0).alias("v"))


@query("tiles", sql="""WITH w AS (SELECT tile, CAST(a.i * 10 AS INTEGER) AS top, CAST(b.i * 10 AS INTEGER) AS left_ FROM tiles, range(4) a(i), range(4) b(i)),
  c AS (SELECT tile, top, left_, k.i - 3 + top AS raw FROM w, range(16) k(i)) SELECT tile, top, left_ AS lft, CAST(raw AS INTEGER) AS raw, CAST(CASE WHEN raw < 0 THEN -raw WHEN raw > 39 THEN 78 - raw ELSE raw END AS INTEGER) AS src FROM c""")
def r11_windows(spark, sf_dir):
    """Read rows of 10-cell windows of a 40-cell grid with a halo of 3, reflected at the border."""
    step = F.sequence(F.lit(0), F.lit(30), F.lit(10))
    w = rel.tiles(spark, sf_dir).select("tile", F.explode(step).alias("top")).select("tile", "top", F.explode(step).alias("lft"))
    w = w.withColumn("raw", F.explode(F.sequence(F.col("top") - 3, F.col("top") + 12)))
    return w.withColumn("src", F.when(F.col("raw") < 0, -F.col("raw")).when(F.col("raw") > 39, 78 - F.col("raw")).otherwise(F.col("raw")))


FEATURES = f"""WITH {HORN}, s AS (SELECT *, 100 * sqrt(dzdx * dzdx + dzdy * dzdy) AS slope, atan2(-dzdx, -dzdy) AS a FROM horn WHERE z IS NOT NULL)"""


@query("points", sql=FEATURES + """ SELECT tile, round(max(z) - min(z), 3) AS relief, round(quantile_cont(slope, 0.5), 2) AS slope_median, round(quantile_cont(slope, 0.9), 2) AS slope_p90,
  round(avg(CASE WHEN slope > 12 THEN 1.0::DOUBLE WHEN slope IS NOT NULL THEN 0 END), 4) AS steep_share FROM s GROUP BY tile""")
def a4_environment(spark, sf_dir):
    slope = R.slope_percent(F.col("dzdx"), F.col("dzdy"))
    g = horn(spark, sf_dir).where("z is not null").withColumn("slope", slope)
    return g.groupBy("tile").agg(
        r(F.max("z") - F.min("z"), 3).alias("relief"),
        r(F.percentile("slope", 0.5), 2).alias("slope_median"),
        r(F.percentile("slope", 0.9), 2).alias("slope_p90"),
        r(F.avg((F.col("slope") > 12).cast("int"))).alias("steep_share"),
    )


@query("points", sql=FEATURES + """ SELECT tile, round(sqrt(pow(avg(sin(a)), 2) + pow(avg(cos(a)), 2)), 4) AS alignment FROM s WHERE slope > 2 GROUP BY tile""")
def a5_aspect_alignment(spark, sf_dir):
    g = horn(spark, sf_dir).where((R.slope_percent(F.col("dzdx"), F.col("dzdy")) > 2))
    a = F.radians(R.aspect(F.col("dzdx"), F.col("dzdy")))
    return g.groupBy("tile").agg(r(F.hypot(F.avg(F.sin(a)), F.avg(F.cos(a)))).alias("alignment"))


@query("points", sql=FEATURES + """ SELECT tile, "row", col, round(z, 4) AS elevation, round(slope, 2) AS slope, round(CASE WHEN slope > 0 THEN sin(a) ELSE 0 END, 4) AS aspect_sin,
  round(CASE WHEN slope > 0 THEN cos(a) ELSE 0 END, 4) AS aspect_cos FROM s WHERE slope IS NOT NULL""")
def p23_terrain_planes(spark, sf_dir):
    a = F.radians(R.aspect(F.col("dzdx"), F.col("dzdy")))
    g = horn(spark, sf_dir).withColumn("slope", R.slope_percent(F.col("dzdx"), F.col("dzdy"))).where("slope is not null")
    part = lambda f: r(F.coalesce(f(a), F.lit(0.0)))
    return g.select("tile", "row", "col", r("z").alias("elevation"), r("slope", 2).alias("slope"), part(F.sin).alias("aspect_sin"), part(F.cos).alias("aspect_cos"))


@query("points", sql=f"""WITH {DEM} SELECT tile, count(*) AS cells, count(z) AS known FROM grid WHERE "row" BETWEEN 5 AND 27 AND col BETWEEN 5 AND 27 GROUP BY tile""")
def p16_core_view(spark, sf_dir):
    inset, last = 5, N - 5 - 1
    core = grid(spark, sf_dir).where(F.col("row").between(inset, last) & F.col("col").between(inset, last))
    return core.groupBy("tile").agg(F.count("*").alias("cells"), F.count("z").alias("known"))


@query("points", sql=f"""WITH {DEM} SELECT tile, avg(z) FILTER (z > 49) IS NULL AS none, round(avg(z) FILTER (z > 40), 3) AS mean FROM grid GROUP BY tile""")
def p17_masked_stat(spark, sf_dir):
    over = lambda k: F.avg(F.when(F.col("z") > k, F.col("z")))
    return grid(spark, sf_dir).groupBy("tile").agg(over(49).isNull().alias("none"), r(over(40), 3).alias("mean"))


@query("points", sql=f"""WITH {DEM} SELECT tile, "row", col, round(z / 60, 5) AS scaled, round(z - avg(z) OVER (PARTITION BY tile), 3) AS relative, round(z / 60 * 60, 3) AS real FROM grid WHERE z IS NOT NULL""")
def p19_normalise(spark, sf_dir):
    """Scaled by a constant, relative to the tile's mean, and back (p20)."""
    g = grid(spark, sf_dir).where("z is not null")
    mean = g.groupBy("tile").agg(F.avg("z").alias("mean"))  # one row a tile; a window would gather each tile in one task
    scaled = F.col("z") / F.lit(60.0)
    return g.join(mean, "tile").select("tile", "row", "col", r(scaled, 5).alias("scaled"), r(F.col("z") - F.col("mean"), 3).alias("relative"), r(scaled * 60, 3).alias("real"))


@query("points", sql=f"""WITH {DEM}, c AS (SELECT * FROM (VALUES (0, 'elevation'), (1, 'cover'), (2, 'valid')) AS d(ord, channel))
  SELECT tile, "row", col, CAST(ord AS INTEGER) AS ord, channel, round(CASE WHEN ord = 0 THEN coalesce(z, 0) WHEN ord = 1 THEN 0 WHEN z IS NULL THEN 0 ELSE 1 END, 4) AS v FROM grid, c""")
def p21_stack_planes(spark, sf_dir):
    """All channels for every cell: unknown cells and absent planes are 0, valid tells them apart."""
    g = grid(spark, sf_dir)
    planes = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("channel"), v.alias("v")) for i, (n, v) in enumerate((("elevation", F.coalesce("z", F.lit(0.0))), ("cover", F.lit(0.0)), ("valid", F.col("z").isNotNull().cast("double"))))])
    return g.select("tile", "row", "col", F.inline(planes)).withColumn("v", r("v"))


@query("points", sql=f"""WITH {DEM}, o AS (SELECT g.tile, g."row", g.col, min(sqrt(pow(h."row" - g."row", 2) + pow(h.col - g.col, 2))) AS d FROM grid g LEFT JOIN grid h ON h.tile = g.tile AND h.z > 45
  AND pow(h."row" - g."row", 2) + pow(h.col - g.col, 2) <= 25 GROUP BY g.tile, g."row", g.col) SELECT tile, "row", col, round(coalesce(d, 5), 4) AS distance, round(least(1, 0.2 + 0.8 * coalesce(d, 5) / 5), 4) AS weight FROM o""")
def w9_distance(spark, sf_dir):
    """Distance to the nearest set cell, clamped; and the ramp of weights over it (w10)."""
    g = grid(spark, sf_dir).withColumn("on", F.coalesce(F.col("z") > 45, F.lit(False)))
    d = R.distance_within(g, 5.0)
    return d.select("tile", "row", "col", r("distance").alias("distance"), r(F.least(F.lit(1.0), 0.2 + 0.8 * F.col("distance") / 5)).alias("weight"))


@query("points", sql=f"""WITH {DEM}, c AS (SELECT tile, CAST(floor(33 - y) AS INTEGER) AS "row", CAST(floor(x) AS INTEGER) AS col, count(*) AS n FROM points GROUP BY ALL)
  SELECT g.tile, g."row", g.col, round(coalesce(sum(c.n), 0) / 25.0::DOUBLE * 1e6, 1) AS per_km2 FROM grid g LEFT JOIN c ON c.tile = g.tile AND abs(c."row" - g."row") <= 2 AND abs(c.col - g.col) <= 2 GROUP BY g.tile, g."row", g.col""")
def a29_density(spark, sf_dir):
    p = rel.points(spark, sf_dir)
    n = p.groupBy("tile", F.floor(33 - F.col("y")).cast("int").alias("row"), F.floor("x").cast("int").alias("col")).agg(F.count("*").alias("n"))
    s = R.box_sums(R.dense(n, N, N, "n"), 2, total=F.coalesce("n", F.lit(0)))
    return s.select("tile", "row", "col", r(F.col("total") / F.lit(25.0) * 1e6, 1).alias("per_km2"))


@query("stack", sql="SELECT tile, cell, min(v) AS lo, round(avg(v), 4) AS mean, max(v) AS hi FROM stack GROUP BY ALL")
def a13_channel_summary(spark, sf_dir):
    return rel.stack(spark, sf_dir).groupBy("tile", "cell").agg(F.min("v").alias("lo"), r(F.avg("v")).alias("mean"), F.max("v").alias("hi"))


@query("stack", sql='SELECT a.tile, a.cell, count(*) FILTER (b.v > 0) AS n FROM stack a JOIN stack b ON a.tile = b.tile AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND a.cell <> b.cell WHERE a.v > 0 GROUP BY ALL')
def w7_neighbour_count(spark, sf_dir):
    s = rel.stack(spark, sf_dir).withColumn("on", (F.col("v") > 0).cast("long"))
    return R.box_sums(s, 1, n=F.col("on")).where("on = 1").select("tile", "cell", (F.col("n") - 1).alias("n"))


CHANNEL_SQL = dims.values_sql([(i, *c) for i, c in enumerate(dims.CHANNELS)], "ord, channel, source, normalise, scale")


@query(sql=f"SELECT source, CAST(min(ord) AS INTEGER) AS first_ord, count(*) AS n, string_agg(channel, ',' ORDER BY ord) AS names FROM {CHANNEL_SQL} WHERE source IS NOT NULL GROUP BY source")
def p36_stack_spec(spark, sf_dir):
    c = dims.channels(spark).where("source is not null")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "channel"))), lambda x: x["channel"]), ",")
    return c.groupBy("source").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"), names.alias("names"))
