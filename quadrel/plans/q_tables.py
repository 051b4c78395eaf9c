"""Queries over predicates, dimensions, buildings, tiles, names and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, geo
from ..operators import rangejoin as J
from ..operators import splits as S
from . import relations as rel
from .catalog import query
from .catalog import rounded as r

CORE = 200.0


def boxes(spark, sf_dir) -> tuple[DataFrame, tuple]:
    """Buildings and their bounding box."""
    b = rel.buildings(spark, sf_dir)
    return b, (F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side"))


def core(spark, sf_dir, halo: float = 0.0) -> DataFrame:
    return J.with_core(rel.tiles(spark, sf_dir), CORE, halo)


TILE = "c AS (SELECT tile, ix * 200.0::DOUBLE AS minx, iy * 200.0::DOUBLE AS miny, (ix + 1) * 200.0::DOUBLE AS maxx, (iy + 1) * 200.0::DOUBLE AS maxy FROM tiles)"


@query("buildings", "tiles", sql=f"WITH {TILE} SELECT tile, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM buildings JOIN c ON x + side > minx AND maxx > x AND y + side > miny AND maxy > y GROUP BY tile")
def p1_overlapping_buildings(spark, sf_dir):
    b, box = boxes(spark, sf_dir)
    return J.join_tiles(b, box, core(spark, sf_dir), CORE, 0.0, geo.overlaps).groupBy("tile").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("nodes", "tiles", sql=f"WITH {TILE} SELECT tile, count(*) AS n FROM nodes JOIN c ON x >= minx AND x < maxx AND y >= miny AND y < maxy GROUP BY tile")
def p2_contained_nodes(spark, sf_dir):
    n = rel.nodes(spark, sf_dir).withColumns({"ix": F.floor(F.col("x") / CORE).cast("int"), "iy": F.floor(F.col("y") / CORE).cast("int")})
    return n.join(rel.tiles(spark, sf_dir), ["ix", "iy"]).groupBy("tile").agg(F.count("*").alias("n"))


@query("buildings", "tiles", sql=f"WITH {TILE} SELECT tile, count(*) AS n FROM buildings JOIN c ON x + side >= minx - 20 AND maxx + 20 >= x AND y + side >= miny - 20 AND maxy + 20 >= y GROUP BY tile")
def j4_buildings_by_footprint(spark, sf_dir):
    """Footprint box against the tile grown by a halo (p3), touching edges included (p6)."""
    b, box = boxes(spark, sf_dir)
    return J.join_tiles(b, box, core(spark, sf_dir, 20.0), CORE, 20.0, geo.touches).groupBy("tile").agg(F.count("*").alias("n"))


@query("buildings", "tiles", sql=f"WITH {TILE} SELECT tile, count(*) AS n FROM buildings JOIN c ON x >= minx - 20 AND x < maxx + 20 AND y >= miny - 20 AND y < maxy + 20 GROUP BY tile")
def j4_buildings_by_vertex(spark, sf_dir):
    """The other rule: the first vertex lies in the grown tile."""
    b, _ = boxes(spark, sf_dir)
    inside = lambda box, area: geo.contains(area, box[0], box[1])
    return J.join_tiles(b, (F.col("x"), F.col("y"), F.col("x"), F.col("y")), core(spark, sf_dir, 20.0), CORE, 20.0, inside).groupBy("tile").agg(F.count("*").alias("n"))


@query("buildings", "tiles", sql="""SELECT tile, min(id) AS first_id FROM tiles JOIN buildings ON x < ix * 200 + 100 AND x + side * 4 > ix * 200 + 100 AND y < iy * 200 + 100 AND y + side * 4 > iy * 200 + 100 GROUP BY tile""")
def j5_first_box_at_centre(spark, sf_dir):
    """The first box, in order, that holds a tile's centre strictly."""
    b = rel.buildings(spark, sf_dir)
    box = (F.col("x"), F.col("y"), F.col("x") + 4 * F.col("side"), F.col("y") + 4 * F.col("side"))
    at = lambda area: ((area[0] + area[2]) / 2, (area[1] + area[3]) / 2)
    inside = lambda box, area: (box[0] < at(area)[0]) & (box[2] > at(area)[0]) & (box[1] < at(area)[1]) & (box[3] > at(area)[1])
    return J.join_tiles(b, box, core(spark, sf_dir), CORE, 0.0, inside).groupBy("tile").agg(F.min("id").alias("first_id"))


@query("tiles", sql="SELECT a.tile, b.tile AS other FROM tiles a JOIN tiles b ON a.tile <> b.tile AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1")
def j18_neighbour_tiles(spark, sf_dir):
    t = rel.tiles(spark, sf_dir)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = t.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).where("dx <> 0 or dy <> 0")
    around = around.select("tile", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"))
    return around.join(t.select("ix", "iy", F.col("tile").alias("other")), ["ix", "iy"]).select("tile", "other")


@query("tiles", sql="""SELECT DISTINCT a.tile FROM tiles a JOIN tiles b ON a.site % 3 <> b.site % 3 AND greatest(abs(a.ix - b.ix), abs(a.iy - b.iy)) <= 1""")
def j7_buffer_tiles(spark, sf_dir):
    """Tiles within one step (Chebyshev, m23) of a tile that is assigned elsewhere: l1's buffer."""
    parts = spark.createDataFrame([(i, str(i % 3)) for i in range(5)], "site int, part string")
    return S.assigned(rel.tiles(spark, sf_dir), parts).where("part = 'buffer'").select("tile")


@query("tiles", sql="""SELECT least(a.site % 3, b.site % 3) AS part, greatest(a.site % 3, b.site % 3) AS other, min(least(a.tile, b.tile) * 100 + greatest(a.tile, b.tile)) AS witness
  FROM tiles a JOIN tiles b ON a.site % 3 < b.site % 3 AND greatest(abs(a.ix - b.ix), abs(a.iy - b.iy)) <= 1 GROUP BY 1, 2""")
def j8_split_violations(spark, sf_dir):
    """One witness, the first, for each two parts that come too close (l2)."""
    t = rel.tiles(spark, sf_dir).withColumn("part", F.col("site") % 3)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    reach = t.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    reach = reach.select((F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"), F.col("part").alias("other"), F.col("tile").alias("near"))
    pairs = t.join(reach, ["ix", "iy"]).where("part < other")
    return pairs.groupBy("part", "other").agg(F.min(F.least("tile", "near") * 100 + F.greatest("tile", "near")).alias("witness"))


@query("tiles", sql="SELECT site, count(*) AS n, CASE site % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS part FROM tiles GROUP BY site")
def a31_split_counts(spark, sf_dir):
    part = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("site") % 3 + 1)
    return rel.tiles(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n")).withColumn("part", part)


@query("tiles", sql="SELECT f.site AS fold, t.tile, CASE WHEN t.site = f.site THEN 'held' ELSE 'train' END AS side FROM tiles t, (SELECT DISTINCT site FROM tiles) f")
def l5_leave_one_site_out(spark, sf_dir):
    """One fold a site; sites are a handful, gathered as an array and exploded."""
    return S.folds(rel.tiles(spark, sf_dir))


@query("tiles", sql="SELECT tile, site FROM tiles WHERE site % 3 <> 1 AND site IN (SELECT site FROM tiles GROUP BY site HAVING count(*) >= 5)")
def l4_configured_fold(spark, sf_dir):
    t = rel.tiles(spark, sf_dir)
    large = t.groupBy("site").agg(F.count("*").alias("n")).where("n >= 5")
    return t.where("site % 3 <> 1").join(large, "site", "left_semi").select("tile", "site")


@query("points", sql="""WITH d AS (SELECT DISTINCT tile, CAST(floor(33 - y) AS INTEGER) AS rw, CAST(floor(x) AS INTEGER) AS cl FROM points WHERE floor(33 - y) BETWEEN 0 AND 31 AND floor(x) <= 31),
  p AS (SELECT t.tile, a.i * 4 AS top, b.i * 4 AS lft FROM (SELECT DISTINCT tile FROM points) t, range(7) a(i), range(7) b(i))
  SELECT p.tile, CAST(top AS INTEGER) AS top, CAST(lft AS INTEGER) AS lft, round(count(d.tile) / 64.0::DOUBLE, 5) AS known FROM p LEFT JOIN d ON d.tile = p.tile AND rw >= top AND rw < top + 8 AND cl >= lft AND cl < lft + 8
  GROUP BY p.tile, top, lft HAVING count(d.tile) / 64.0::DOUBLE >= 0.25""")
def l6_patches(spark, sf_dir):
    """Crops of 8 cells at a stride of 4 with a quarter of their cells known; a cell tells its crops."""
    p = rel.points(spark, sf_dir)
    cells = p.select("tile", F.floor(33 - F.col("y")).cast("int").alias("rw"), F.floor("x").cast("int").alias("cl")).distinct().where("rw between 0 and 31 and cl <= 31")
    starts = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - 4) / 4).cast("int")), F.least(F.lit(6), F.floor(F.col(c) / 4).cast("int")))
    own = cells.withColumn("a", F.explode(starts("rw"))).withColumn("b", F.explode(starts("cl")))
    own = own.where("rw >= a * 4 and rw < a * 4 + 8 and cl >= b * 4 and cl < b * 4 + 8")
    return own.groupBy("tile", (F.col("a") * 4).alias("top"), (F.col("b") * 4).alias("lft")).agg((F.count("*") / F.lit(64.0)).alias("known")).where("known >= 0.25").withColumn("known", r("known", 5))


@query("tiles", sql="SELECT tile, printf('z%02d_x%06d_y%06d', site + 1, ix - 2, iy - 3) AS name, site + 1 AS zone, ix - 2 AS px, iy - 3 AS py FROM tiles")
def m14_tile_names(spark, sf_dir):
    """Names of tiles, and what is read back from them (m15)."""
    t = rel.tiles(spark, sf_dir)
    t = t.withColumn("name", geo.tile_id(F.col("site") + 1, F.col("ix") - 2, F.col("iy") - 3))
    zone, px, py = geo.tile_parts(F.col("name"))
    return t.select("tile", "name", zone.alias("zone"), px.alias("px"), py.alias("py"))


@query("tiles", sql="SELECT tile, ix * 200.0::DOUBLE - 25 AS minx, iy * 200.0::DOUBLE - 25 AS miny, ix * 200.0::DOUBLE + 225 AS maxx, iy * 200.0::DOUBLE + 225 AS maxy, CAST(round_even(250 / 1.5::DOUBLE, 0) AS INTEGER) AS cells FROM tiles")
def m22_tile_bounds(spark, sf_dir):
    """Read extents (p3, m13): the core with its halo, and the grid's size by half-even rounding."""
    return core(spark, sf_dir, 25.0).select("tile", "minx", "miny", "maxx", "maxy", F.bround((F.col("maxx") - F.col("minx")) / 1.5, 0).cast("int").alias("cells"))


@query("buildings", sql="SELECT b.id, CAST(x.i AS INTEGER) AS ix, CAST(y.i AS INTEGER) AS iy FROM buildings b, range(60) x(i), range(60) y(i) WHERE x.i >= floor(b.x / 20) AND x.i < ceil((b.x + side) / 20) AND y.i >= floor(b.y / 20) AND y.i < ceil((b.y + side) / 20)")
def t8_tiles_covering(spark, sf_dir):
    b = rel.buildings(spark, sf_dir)
    cover = lambda c: F.sequence(F.floor(F.col(c) / 20).cast("int"), (F.ceil((F.col(c) + F.col("side")) / 20) - 1).cast("int"))
    return b.select("id", F.explode(cover("x")).alias("ix"), "y", "side").select("id", "ix", F.explode(cover("y")).alias("iy"))


@query("buildings", sql="SELECT id, round(side * side, 4) AS area, round(4 * side, 4) AS perimeter, true AS closed FROM buildings")
def m6_ring_measures(spark, sf_dir):
    b = rel.buildings(spark, sf_dir).withColumn("ring", geo.square(F.col("x"), F.col("y"), F.col("side")))
    return b.select("id", r(geo.ring_area(F.col("ring"))).alias("area"), r(geo.line_length(F.col("ring"))).alias("perimeter"), geo.closed(F.col("ring")).alias("closed"))


@query("buildings", sql="SELECT id, printf('POLYGON ((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))', x, y, x + side, y, x + side, y + side, x, y + side, x, y) AS wkt, round(side * side, 4) AS area FROM buildings")
def m37_wkt(spark, sf_dir):
    """Footprints as text, and the area of what is read back."""
    b = rel.buildings(spark, sf_dir).withColumn("wkt", geo.wkt(geo.square(F.col("x"), F.col("y"), F.col("side"))))
    return b.select("id", "wkt", r(geo.ring_area(geo.ring_of(F.col("wkt")))).alias("area"))


@query("buildings", sql="SELECT id, CAST(floor(x / 2) AS BIGINT) AS k, coalesce(height, CASE WHEN storeys <> 0 THEN storeys * 3.0::DOUBLE END) AS estimated FROM buildings")
def p29_estimated_height(spark, sf_dir):
    b = rel.buildings(spark, sf_dir)
    return b.select("id", F.floor(F.col("x") / 2).alias("k"), F.coalesce("height", F.nullif(F.col("storeys"), F.lit(0)) * 3.0).alias("estimated"))


USAGE_SQL = dims.values_sql(list(dims.USAGE_CODES.items()), "usage, fine")
FINE_SQL = dims.values_sql(list(dims.FINE_TYPES.items()), "fine, coarse")


@query("buildings", sql=f"""SELECT b.id, coalesce(u.fine, 'unknown') AS fine, coalesce(f.coarse, 'unknown') AS coarse, u.fine IS NOT NULL AS mapped FROM buildings b LEFT JOIN (SELECT * FROM {USAGE_SQL}) u ON u.usage = trim(b.usage)
  LEFT JOIN (SELECT * FROM {FINE_SQL}) f ON f.fine = coalesce(u.fine, 'unknown')""")
def p12_usage_types(spark, sf_dir):
    """Usage code -> fine -> coarse type (p14, j1), unknown where nothing fits."""
    b = rel.buildings(spark, sf_dir).withColumn("usage", F.trim("usage"))
    b = b.join(dims.mapping(spark, dims.USAGE_CODES, "usage", "fine"), "usage", "left").withColumn("mapped", F.col("fine").isNotNull())
    b = b.withColumn("fine", F.coalesce("fine", F.lit("unknown"))).join(dims.mapping(spark, dims.FINE_TYPES, "fine", "coarse"), "fine", "left")
    return b.select("id", "fine", F.coalesce("coarse", F.lit("unknown")).alias("coarse"), "mapped")


@query("buildings", sql=f"""SELECT usage, count(*) AS n FROM buildings WHERE usage NOT IN (SELECT usage FROM {USAGE_SQL}) GROUP BY usage""")
def a36_unmapped_codes(spark, sf_dir):
    b = rel.buildings(spark, sf_dir)
    return b.join(dims.mapping(spark, dims.USAGE_CODES, "usage", "fine"), "usage", "left_anti").groupBy("usage").agg(F.count("*").alias("n"))


TAGS = ["motorway", " Trunk_Link ", "PRIMARY", "steps", "proposed", "road", "service", "cycleway", "bus_stop", "residential"]
TAG_SQL = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"
HIGHWAY_SQL = dims.values_sql(list(dims.HIGHWAYS.items()), "tag, road_class")


@query(sql=f"""SELECT p_partkey AS id, coalesce(h.road_class, 'unknown') AS road_class, h.road_class IS NOT NULL AS mapped FROM part LEFT JOIN (SELECT * FROM {HIGHWAY_SQL}) h ON h.tag = lower(trim({TAG_SQL}[p_partkey % 10 + 1]))""")
def p11_highway_classes(spark, sf_dir):
    t = rel.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim(F.element_at(F.array(*map(F.lit, TAGS)), (F.col("p_partkey") % 10 + 1).cast("int")))).alias("tag"))
    t = t.join(dims.mapping(spark, dims.HIGHWAYS, "tag", "road_class"), "tag", "left")
    return t.select("id", F.coalesce("road_class", F.lit("unknown")).alias("road_class"), F.col("road_class").isNotNull().alias("mapped"))


BUILDING_TAG_SQL = dims.values_sql(list(dims.BUILDING_TAGS.items()), "tag, fine")


@query(sql=f"""SELECT tag, coalesce(b.fine, 'unknown') AS fine, n FROM (SELECT lower(p_brand) AS tag, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'hotel', 1 UNION ALL SELECT 'barn', 2) LEFT JOIN (SELECT * FROM {BUILDING_TAG_SQL}) b USING (tag)""")
def p13_building_tags(spark, sf_dir):
    t = rel.table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("tag")).agg(F.count("*").alias("n"))
    t = t.unionByName(spark.createDataFrame([("hotel", 1), ("barn", 2)], "tag string, n long"))
    return t.join(dims.mapping(spark, dims.BUILDING_TAGS, "tag", "fine"), "tag", "left").select("tag", F.coalesce("fine", F.lit("unknown")).alias("fine"), "n")


CODE_SQL = dims.values_sql(list(dims.LANDUSE_CODES.items()), "code, cls")
GROUP_SQL = dims.values_sql(list(dims.LANDUSE_GROUPS.items()), "cls, grp")


@query(sql=f"""SELECT code, coalesce(c.cls, 'unknown') AS cls, g.grp, n FROM (SELECT printf('%02d00', p_size % 18) AS code, count(*) AS n FROM part GROUP BY 1) LEFT JOIN (SELECT * FROM {CODE_SQL}) c USING (code) LEFT JOIN (SELECT * FROM {GROUP_SQL}) g ON g.cls = c.cls""")
def p15_landuse_groups(spark, sf_dir):
    t = rel.table(spark, sf_dir, "part").groupBy(F.format_string("%02d00", F.col("p_size") % 18).alias("code")).agg(F.count("*").alias("n"))
    t = t.join(dims.mapping(spark, dims.LANDUSE_CODES, "code", "cls"), "code", "left").join(dims.mapping(spark, dims.LANDUSE_GROUPS, "cls", "grp"), "cls", "left")
    return t.select("code", F.coalesce("cls", F.lit("unknown")).alias("cls"), "grp", "n")


@query(sql="""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN printf('%04d', 5000 + p_partkey % 800) WHEN 1 THEN printf('%04d%02d', 5000 + p_partkey % 800, p_partkey % 90) ELSE printf('%04d%02d%02d', 5000 + p_partkey % 800, p_partkey % 78, p_partkey % 100) END AS code FROM part),
  d AS (SELECT *, length(code) AS n, TRY_CAST(substr(code, 5, 1) AS INTEGER) AS e, TRY_CAST(substr(code, 6, 1) AS INTEGER) AS f, TRY_CAST(substr(code, 7, 1) AS INTEGER) AS g, TRY_CAST(substr(code, 8, 1) AS INTEGER) AS h FROM c)
  SELECT id, code, round(CASE WHEN n = 4 OR (e <= 7 AND f <= 7) THEN CAST(substr(code, 3, 2) AS INTEGER) + 100 + CASE WHEN n >= 6 THEN f / 8.0::DOUBLE ELSE 0 END + CASE WHEN n = 8 THEN h / 80.0::DOUBLE ELSE 0 END END, 6) AS west,
    round(CASE WHEN n = 4 OR (e <= 7 AND f <= 7) THEN CAST(substr(code, 1, 2) AS INTEGER) / 1.5::DOUBLE + CASE WHEN n >= 6 THEN e / 12.0::DOUBLE ELSE 0 END + CASE WHEN n = 8 THEN g / 120.0::DOUBLE ELSE 0 END END, 6) AS south FROM d""")
def m16_mesh_codes(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, F.format_string("%04d", 5000 + k % 800)).when(k % 3 == 1, F.format_string("%04d%02d", 5000 + k % 800, k % 90)).otherwise(F.format_string("%04d%02d%02d", 5000 + k % 800, k % 78, k % 100))
    t = rel.table(spark, sf_dir, "part").select(k.alias("id"), code.alias("code"))
    west, south, _, _ = geo.mesh_box(F.col("code"))
    return t.select("id", "code", r(west, 6).alias("west"), r(south, 6).alias("south"))


@query(sql="""WITH n AS (SELECT p_partkey AS id, 'udx_' || CASE p_partkey % 4 WHEN 0 THEN printf('%08d', 52385000 + p_partkey) WHEN 1 THEN printf('%06d', 523850 + p_partkey) WHEN 2 THEN printf('%05d', p_partkey) ELSE printf('a%04db', p_partkey % 9999) END || '_bldg' AS name FROM part)
  SELECT id, nullif(regexp_extract(name, '(?:^|[^0-9])([0-9]{8}|[0-9]{6}|[0-9]{4})(?:[^0-9]|$)', 1), '') AS code FROM n""")
def m17_code_in_name(spark, sf_dir):
    k = F.col("p_partkey")
    part = F.when(k % 4 == 0, F.format_string("%08d", 52385000 + k)).when(k % 4 == 1, F.format_string("%06d", 523850 + k)).when(k % 4 == 2, F.format_string("%05d", k)).otherwise(F.format_string("a%04db", k % 9999))
    return rel.table(spark, sf_dir, "part").select(k.alias("id"), geo.mesh_code_in(F.concat(F.lit("udx_"), part, F.lit("_bldg"))).alias("code"))


@query("nodes", sql="""SELECT n.id, CAST((30 + y.i) * 1.5 * 100 + x.i AS BIGINT) AS code FROM (SELECT id, 130 + x / 100 AS west, 30 + y / 100 AS south FROM nodes) n, range(30) x(i), range(40) y(i) WHERE false""".replace("WHERE false", "WHERE 1 = 0") + """ UNION ALL
  SELECT id, CAST(la.i * 100 + lo.i AS BIGINT) FROM (SELECT id, 130 + x / 100 AS west, 30 + y / 100 AS south FROM nodes) n, range(40, 70) la(i), range(25, 45) lo(i)
  WHERE lo.i + 100 < west + 1.2 AND lo.i + 101 > west AND la.i / 1.5::DOUBLE < south + 0.9 AND (la.i + 1) / 1.5::DOUBLE > south""")
def m18_primary_meshes(spark, sf_dir):
    """Codes of the first-order meshes that a box overlaps (m19's filter is the same predicate)."""
    n = rel.nodes(spark, sf_dir).select("id", (130 + F.col("x") / 100).alias("west"), (30 + F.col("y") / 100).alias("south"))
    la = F.sequence(F.floor(F.col("south") * 1.5) - 1, F.ceil((F.col("south") + 0.9) * 1.5) + 1)
    lo = F.sequence(F.floor(F.col("west")) - 101, F.ceil(F.col("west") + 1.2) - 99)
    c = n.withColumn("la", F.explode(la)).withColumn("lo", F.explode(lo))
    box = (F.col("lo") + 100.0, F.col("la") / 1.5, F.col("lo") + 101.0, (F.col("la") + 1) / 1.5)
    own = (F.col("west"), F.col("south"), F.col("west") + 1.2, F.col("south") + 0.9)
    return c.where(geo.overlaps(box, own)).select("id", (F.col("la") * 100 + F.col("lo")).alias("code"))


@query("nodes", sql="""WITH p AS (SELECT id, 138 + x / 1000 AS lon, 34 + y / 1000 AS lat FROM nodes) SELECT id, CAST(floor((lon + 180) / 360 * 65536) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536) AS BIGINT) AS ty FROM p""")
def m20_slippy_tiles(spark, sf_dir):
    n = rel.nodes(spark, sf_dir)
    x, y = geo.slippy(138 + F.col("x") / 1000, 34 + F.col("y") / 1000, 16)
    return n.select("id", x.alias("tx"), y.alias("ty"))


@query("nodes", sql="""SELECT id, round(x * 1000 / (4096 * 16.0::DOUBLE) * 360 - 180, 6) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * y * 60 / (4096 * 16.0::DOUBLE))))), 6) AS lat FROM nodes""")
def m21_slippy_places(spark, sf_dir):
    lon, lat = geo.slippy_place(F.col("x") * 1000, F.col("y") * 60, 4096, 4)
    return rel.nodes(spark, sf_dir).select("id", r(lon, 6).alias("lon"), r(lat, 6).alias("lat"))


@query("nodes", sql="""WITH q AS (SELECT id, printf('[out:xml];way["highway"](%.6f,%.6f,%.6f,%.6f);', 34 + y / 1000, 138 + x / 1000, 34.01 + y / 1000, 138.01 + x / 1000) AS q FROM nodes) SELECT id, q, substr(sha256(q), 1, 16) AS cache_key FROM q""")
def s34_area_query(spark, sf_dir):
    """The text of an area query and the key of its cache (s33, m38)."""
    at = lambda k, c: F.lit(k) + F.col(c) / 1000
    q = F.format_string('[out:xml];way["highway"](%.6f,%.6f,%.6f,%.6f);', at(34.0, "y"), at(138.0, "x"), at(34.01, "y"), at(138.01, "x"))
    return rel.nodes(spark, sf_dir).select("id", q.alias("q")).withColumn("cache_key", F.substring(F.sha2("q", 256), 1, 16))


@query(sql="""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '12.0' WHEN 1 THEN '1998-04-01' WHEN 2 THEN '' WHEN 3 THEN 'x' ELSE CAST(p_partkey + 1400 AS VARCHAR) END AS s FROM part),
  y AS (SELECT id, s, TRY_CAST(s AS DOUBLE) AS f, coalesce(CAST(TRY_CAST(s AS DOUBLE) AS BIGINT), TRY_CAST(nullif(regexp_extract(s, '^([0-9]{4})', 1), '') AS BIGINT)) AS i FROM t)
  SELECT id, f, i::DOUBLE AS i, CASE WHEN i BETWEEN 1500 AND 2027 THEN i::DOUBLE END AS plausible FROM y""")
def p26_tolerant_casts(spark, sf_dir):
    """Numbers out of untidy text, and years that can be (p25)."""
    k = F.col("p_partkey")
    s = F.when(k % 5 == 0, "12.0").when(k % 5 == 1, "1998-04-01").when(k % 5 == 2, "").when(k % 5 == 3, "x").otherwise((k + 1400).cast("string"))
    t = rel.table(spark, sf_dir, "part").select(k.alias("id"), s.alias("s"))
    f = F.col("s").try_cast("double")
    i = F.coalesce(f.cast("long"), F.nullif(F.regexp_extract("s", "^([0-9]{4})", 1), F.lit("")).try_cast("long"))
    return t.select("id", f.alias("f"), i.cast("double").alias("i")).withColumn("plausible", F.when(F.col("i").between(1500, 2027), F.col("i")))


@query(sql="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'bridge' WHEN o_orderkey % 5 = 0 THEN 'tunnel' WHEN o_orderkey % 7 = 0 THEN 'embankment' WHEN o_orderkey % 11 = 0 THEN 'cutting' ELSE 'ground' END AS structure,
  coalesce(nullif(o_orderkey % 4, 0), 2) AS lanes, o_orderkey % 6 IN (1, 2, 4) AS oneway FROM orders""")
def p27_way_attributes(spark, sf_dir):
    """Structure by precedence, lanes whose 0 falls to the class's, one-way spellings (p28)."""
    k = F.col("o_orderkey")
    tags = F.create_map(*[v for n, name in ((3, "bridge"), (5, "tunnel"), (7, "embankment"), (11, "cutting")) for v in (F.lit(name), F.when(k % n == 0, "yes").otherwise("no"))])
    has = lambda c: F.coalesce(F.col("tags")[c], F.lit("no")) != "no"
    t = rel.table(spark, sf_dir, "orders").select(k.alias("id"), tags.alias("tags"), F.element_at(F.array(*map(F.lit, ("no", "yes", "true", "", "-1", "x"))), (k % 6 + 1).cast("int")).alias("ow"))
    return t.select("id", J.case([(has(c), c) for c in ("bridge", "tunnel", "embankment", "cutting")], "ground").alias("structure"), F.coalesce(F.nullif(F.col("id") % 4, F.lit(0).cast("long")), F.lit(2).cast("long")).alias("lanes"), F.col("ow").isin("yes", "true", "1", "-1").alias("oneway"))


@query(sql="""WITH t AS (SELECT o_orderkey AS id, (o_custkey % 90) || ' ' || (o_orderkey % 77) || '  ' || (o_orderkey % 5) || ' ' || (o_custkey % 60) || ' 1 2' AS s FROM orders) SELECT id, CAST(len(regexp_split_to_array(trim(s), '\\s+')) // 3 AS INTEGER) AS n,
  CAST(regexp_split_to_array(trim(s), '\\s+')[1] AS DOUBLE) AS lat, CAST(regexp_split_to_array(trim(s), '\\s+')[2] AS DOUBLE) AS lon, CAST(regexp_split_to_array(trim(s), '\\s+')[4] AS DOUBLE) AS lat2 FROM t""")
def s13_position_lists(spark, sf_dir):
    """Triples out of a position list; a list that doesn't divide by three is an error."""
    t = rel.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("", (F.col("o_custkey") % 90).cast("string"), F.lit(" "), (F.col("o_orderkey") % 77).cast("string"), F.lit("  "), (F.col("o_orderkey") % 5).cast("string"), F.lit(" "), (F.col("o_custkey") % 60).cast("string"), F.lit(" 1 2")).alias("s"))
    t = t.withColumn("v", F.transform(F.split(F.trim("s"), r"\s+"), lambda x: x.cast("double")))
    n = F.when(F.size("v") % 3 == 0, F.floor(F.size("v") / 3).cast("int")).otherwise(F.raise_error("positions don't come in threes").cast("int"))
    at = lambda i: F.get("v", F.lit(i))
    return t.select("id", n.alias("n"), at(0).alias("lat"), at(1).alias("lon"), at(3).alias("lat2"))


@query("buildings", "tiles", sql="""WITH box AS (SELECT *, CAST(floor(x / 2) AS BIGINT) AS x0, CAST(floor(y / 2) AS BIGINT) AS y0, CAST(floor((x + side) / 2) AS BIGINT) + 1 AS x1, CAST(floor((y + side) / 2) AS BIGINT) + 1 AS y1 FROM buildings WHERE height IS NOT NULL),
  each_ AS (SELECT *, unnest(range((x1 - x0) * (y1 - y0))) AS i FROM box), tall AS (SELECT *, x0 + i % (x1 - x0) AS cx, y0 + i // (x1 - x0) AS cy FROM each_),
  cells AS (SELECT * FROM tall WHERE cx * 2 + 1 >= x AND cx * 2 + 1 < x + side AND cy * 2 + 1 >= y AND cy * 2 + 1 < y + side)
  SELECT cx, cy, max(height) AS height, count(*) AS n FROM cells GROUP BY cx, cy""")
def r1_building_burn(spark, sf_dir):
    """Cells of 2 m whose centre is in a footprint (r1, r3), with the tallest height (t4)."""
    b = rel.buildings(spark, sf_dir).where("height is not null").withColumn("ring", geo.square(F.col("x"), F.col("y"), F.col("side")))
    cells = lambda c: F.sequence(F.floor(F.col(c) / 2), F.floor((F.col(c) + F.col("side")) / 2))
    c = b.select("height", "ring", "y", "side", F.explode(cells("x")).alias("cx")).withColumn("cy", F.explode(cells("y")))
    inside = geo.in_ring(F.col("ring"), F.col("cx") * 2 + F.lit(1.0), F.col("cy") * 2 + F.lit(1.0))
    return c.where(inside).groupBy("cx", "cy").agg(F.max("height").alias("height"), F.count("*").alias("n"))


@query("manifests", sql="SELECT tile, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources, count(DISTINCT source_id) AS n FROM manifests WHERE role = 'input' GROUP BY tile")
def a11_source_ids(spark, sf_dir):
    m = rel.manifests(spark, sf_dir).where("role = 'input'")
    return m.groupBy("tile").agg(F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("sources"), F.countDistinct("source_id").alias("n"))


@query("nodes", sql="SELECT id, CAST(least(greatest(floor((x - 100) / 8), 0), 99) AS INTEGER) AS col, CAST(least(greatest(floor((900 - y) / 8), 0), 99) AS INTEGER) AS rw, 100 + (least(greatest(floor((x - 100) / 8), 0), 99) + 0.5) * 8 AS centre FROM nodes")
def m12_nearest_cell(spark, sf_dir):
    """Row and column that hold a point (m11), clipped into the grid, and the cell's centre."""
    row, col = geo.cell_of(F.col("x"), F.col("y"), F.lit(100.0), F.lit(900.0), 8.0)
    clip = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(99))
    return rel.nodes(spark, sf_dir).select("id", clip(col).alias("col"), clip(row).alias("rw"), (100 + (clip(col) + 0.5) * 8).alias("centre"))


@query("nodes", sql="SELECT id, CAST((y - 5) * 100 AS BIGINT) AS u_x, CAST((x - 3) * 100 AS BIGINT) AS u_y, x - 3 AS e, y - 5 AS n FROM nodes")
def m24_axis_frames(spark, sf_dir):
    """Local frames: origin taken off first, then axes and units permuted."""
    n = rel.nodes(spark, sf_dir)
    east, north = F.col("x") - 3, F.col("y") - 5
    return n.select("id", (north * 100).cast("long").alias("u_x"), (east * 100).cast("long").alias("u_y"), east.alias("e"), north.alias("n"))


@query("nodes", sql="SELECT id, round(138 + x / 1000, 9) AS lon, round(34 + y / 1000, 9) AS lat FROM nodes")
def m27_projection_round_trip(spark, sf_dir):
    """To the plane of zone 8 and back: equal to the ninth decimal of a degree."""
    n = rel.nodes(spark, sf_dir)
    east, north = geo.project(138 + F.col("x") / 1000, 34 + F.col("y") / 1000, 8)
    n = n.select("id", east.alias("e"), north.alias("n"))
    lon, lat = geo.unproject(F.col("e"), F.col("n"), 8)
    return n.select("id", r(lon, 9).alias("lon"), r(lat, 9).alias("lat"))


@query("points", sql="SELECT tile, round(min(x), 3) AS minx, round(min(y), 3) AS miny, round(max(x), 3) AS maxx, round(max(y), 3) AS maxy FROM points GROUP BY tile")
def a34_extents(spark, sf_dir):
    ends = [r(f(c), 3).alias(f"{n}{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")]
    return rel.points(spark, sf_dir).groupBy("tile").agg(*ends)


@query(sql="""SELECT o_custkey AS archive, o_orderkey AS member, CAST(upto AS BIGINT) AS upto FROM (SELECT *, sum(floor(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS upto FROM orders) WHERE upto <= 1000000""")
def s31_members_within_bytes(spark, sf_dir):
    """Members in order until a byte budget is used up (w12: a running sum)."""
    order = Window.partitionBy("archive").orderBy("member")
    t = rel.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("member"), F.floor("o_totalprice").alias("size"))
    return t.withColumn("upto", F.sum("size").over(order)).where("upto <= 1000000").select("archive", "member", "upto")


@query(sql="SELECT o_custkey AS archive, round(CASE WHEN sum(floor(o_totalprice)) = 0 THEN 0 ELSE 1 - sum(CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice) ELSE 0 END) / sum(floor(o_totalprice)) END, 5) AS saved FROM orders GROUP BY 1")
def s32_saved_fraction(spark, sf_dir):
    size = F.floor("o_totalprice").cast("double")
    t = rel.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("archive"))
    part, whole = F.sum(F.when(F.col("o_orderkey") % 4 == 0, size).otherwise(0.0)), F.sum(size)
    return t.agg(r(F.when(whole == 0, 0.0).otherwise(1 - part / F.nullif(whole, F.lit(0.0))), 5).alias("saved"))
