"""Spatial relations derived from the driver's tables by exact arithmetic, and the same as SQL.

Each relation is a function of (spark, sf_dir); CTES holds the SQL of the same name for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, x, y, z, cls: survey points in tiles of 33 x 33 m."""
    t = table(spark, sf_dir, "lineitem")
    eighth = F.col("l_linenumber") / F.lit(8.0)
    return t.select(
        (F.col("l_suppkey") % 25).cast("int").alias("tile"),
        (F.col("l_partkey") % 32 + eighth).alias("x"),
        (F.col("l_orderkey") % 32 + eighth).alias("y"),
        F.col("l_quantity").alias("z"),
        F.when(F.col("l_returnflag") == "A", 2).otherwise(5).alias("cls"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, ix, iy, site: a 5 x 5 block of tiles in five sites."""
    t = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return t.select(key.cast("int").alias("tile"), (key % 5).cast("int").alias("ix"), F.floor(key / 5).cast("int").alias("iy"), F.col("n_regionkey").cast("int").alias("site"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y."""
    t = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return t.select(key.alias("id"), (key * 97 % 1000).cast("double").alias("x"), (key * 61 % 1000).cast("double").alias("y"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, pos, ref: ordered references; lines that agree in all keys are one."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t.select(F.col("l_orderkey").alias("way"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_partkey").alias("ref"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph, id, u, v, class_no: consecutive references of a way; graph is one of 25."""
    w = ways(spark, sf_dir)
    order = Window.partitionBy("way").orderBy("pos")
    e = w.withColumn("v", F.lead("ref").over(order)).where("v is not null and v <> ref")
    return e.select((F.col("way") % 25).cast("int").alias("graph"), (F.col("way") * 16 + F.col("pos")).alias("id"), F.col("ref").alias("u"), "v", (F.col("ref") % 12).cast("int").alias("class_no"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges with the coordinates of both ends: ux, uy, vx, vy."""
    n = nodes(spark, sf_dir)
    e = edges(spark, sf_dir)
    return e.join(n.toDF("u", "ux", "uy"), "u").join(n.toDF("v", "vx", "vy"), "v").select("graph", "id", "u", "v", "class_no", "ux", "uy", "vx", "vy")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, side, height, storeys, usage: squares of side `side` from (x, y)."""
    t = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return t.select(
        key.alias("id"),
        (key * 97 % 1000).cast("double").alias("x"),
        (key * 61 % 1000).cast("double").alias("y"),
        F.col("p_size").cast("double").alias("side"),
        F.when(key % 7 == 0, None).otherwise(F.floor(F.col("p_retailprice") / 50).cast("double")).alias("height"),
        F.when(key % 5 == 0, None).otherwise((key % 6).cast("int")).alias("storeys"),
        (F.lit(400) + key % 24).cast("string").alias("usage"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, site, three features and three metrics, of customers."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.floor("o_totalprice")).alias("top"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    key = F.col("c_custkey")
    return rows.select(
        key.alias("tile"),
        F.col("n_regionkey").cast("int").alias("site"),
        F.floor("c_acctbal").cast("double").alias("f_balance"),
        (key % 13).cast("double").alias("f_step"),
        F.lit(1.0).alias("f_flat"),
        F.col("n").cast("double").alias("m_orders"),
        F.col("top").cast("double").alias("m_top"),
        (key * 7 % 31).cast("double").alias("m_ring"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, p, truth, valid: a predicted probability, what is there, and whether that is known."""
    t = table(spark, sf_dir, "events")
    return t.select(
        (F.col("user_id") % 25).cast("int").alias("tile"),
        F.least(F.lit(1.0), F.floor(F.col("value")) / F.lit(500.0)).alias("p"),
        (F.col("event_type") == "purchase").alias("truth"),
        (F.col("event_id") % 10 != 3).alias("valid"),
    )


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, site, cell, row, col, v: blocks of 8 x 8 cells, v in thousandths."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), F.col("label").alias("site"), F.posexplode("embedding").alias("cell", "e"))
    return t.select("tile", "site", "cell", F.floor(F.col("cell") / 8).cast("int").alias("row"), (F.col("cell") % 8).cast("int").alias("col"), F.floor(F.col("e").cast("double") * 1000).cast("double").alias("v"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, tier, role, family, commercial, attribution, pin, licence: data sources and their terms."""
    t = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (key % n + 1).cast("int"))
    return t.select(
        F.format_string("src%04d", key).alias("source_id"),
        pick(4, "core", "core", "research", "quarantined").alias("tier"),
        F.when(key % 9 == 4, None).otherwise(pick(3, "input", "training_only", "export")).alias("role"),
        pick(5, "none", "ODbL", "none", "CC-BY-SA", "none # checked").alias("family"),
        (key % 6 != 1).alias("commercial"),
        F.when(key % 7 == 2, None).otherwise(F.concat(F.lit("(c)  Source\t"), (key % 10).cast("string"), F.lit("  org"))).alias("attribution"),
        F.when(key % 3 == 0, F.concat(F.lit("v"), (key % 4).cast("string"))).alias("pin"),
        F.when(key % 8 == 5, "Open; Verify per Vintage").otherwise("Open").alias("licence"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, source_id, role, version: what went into each tile, now and then from no known source."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).cast("int").alias("tile"), F.col("l_suppkey").alias("s")).distinct()
    s = F.col("s")
    return t.where((F.col("tile") + s) % 4 == 0).select(
        "tile",
        F.when((s + F.col("tile")) % 28 == 0, F.format_string("new%04d", s)).otherwise(F.format_string("src%04d", s)).alias("source_id"),
        F.when(s % 2 == 0, "input").otherwise("target").alias("role"),
        F.concat(F.lit("v"), (s % 5).cast("string")).alias("version"),
    )


CTES = {
    "points": """points AS (SELECT CAST(l_suppkey % 25 AS INTEGER) AS tile, l_partkey % 32 + l_linenumber / 8.0::DOUBLE AS x,
        l_orderkey % 32 + l_linenumber / 8.0::DOUBLE AS y, l_quantity AS z, CASE WHEN l_returnflag = 'A' THEN 2 ELSE 5 END AS cls FROM lineitem)""",
    "tiles": """tiles AS (SELECT CAST(n_nationkey AS INTEGER) AS tile, CAST(n_nationkey % 5 AS INTEGER) AS ix, CAST(n_nationkey // 5 AS INTEGER) AS iy,
        CAST(n_regionkey AS INTEGER) AS site FROM nation)""",
    "nodes": "nodes AS (SELECT p_partkey AS id, (p_partkey * 97 % 1000)::DOUBLE AS x, (p_partkey * 61 % 1000)::DOUBLE AS y FROM part)",
    "ways": """ways AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey AS ref
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))""",
    "edges": """edges AS (SELECT CAST(way % 25 AS INTEGER) AS graph, way * 16 + pos AS id, ref AS u, v, CAST(ref % 12 AS INTEGER) AS class_no
        FROM (SELECT *, lead(ref) OVER (PARTITION BY way ORDER BY pos) AS v FROM ways) WHERE v IS NOT NULL AND v <> ref)""",
    "segments": """segments AS (SELECT e.*, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM edges e JOIN nodes a ON a.id = e.u JOIN nodes b ON b.id = e.v)""",
    "buildings": """buildings AS (SELECT p_partkey AS id, (p_partkey * 97 % 1000)::DOUBLE AS x, (p_partkey * 61 % 1000)::DOUBLE AS y, p_size::DOUBLE AS side,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE floor(p_retailprice / 50)::DOUBLE END AS height,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 6 AS INTEGER) END AS storeys, CAST(400 + p_partkey % 24 AS VARCHAR) AS usage FROM part)""",
    "observations": """observations AS (SELECT c_custkey AS tile, CAST(n_regionkey AS INTEGER) AS site, floor(c_acctbal)::DOUBLE AS f_balance, (c_custkey % 13)::DOUBLE AS f_step,
        1.0::DOUBLE AS f_flat, o.n::DOUBLE AS m_orders, o.top::DOUBLE AS m_top, (c_custkey * 7 % 31)::DOUBLE AS m_ring
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n, max(floor(o_totalprice)) AS top FROM orders GROUP BY 1) o ON o_custkey = c_custkey)""",
    "scores": """scores AS (SELECT CAST(user_id % 25 AS INTEGER) AS tile, least(1.0::DOUBLE, floor(value) / 500.0::DOUBLE) AS p, event_type = 'purchase' AS truth, event_id % 10 <> 3 AS valid FROM events)""",
    "stack": """stack AS (SELECT vec_id AS tile, label AS site, CAST(i - 1 AS INTEGER) AS cell, CAST((i - 1) // 8 AS INTEGER) AS "row", CAST((i - 1) % 8 AS INTEGER) AS col, floor(embedding[i]::DOUBLE * 1000) AS v
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))""",
    "registry": """registry AS (SELECT printf('src%04d', s_suppkey) AS source_id, ['core', 'core', 'research', 'quarantined'][s_suppkey % 4 + 1] AS tier,
        CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE ['input', 'training_only', 'export'][s_suppkey % 3 + 1] END AS role,
        ['none', 'ODbL', 'none', 'CC-BY-SA', 'none # checked'][s_suppkey % 5 + 1] AS family, s_suppkey % 6 <> 1 AS commercial,
        CASE WHEN s_suppkey % 7 = 2 THEN NULL ELSE '(c)  Source' || chr(9) || (s_suppkey % 10) || '  org' END AS attribution,
        CASE WHEN s_suppkey % 3 = 0 THEN 'v' || (s_suppkey % 4) END AS pin, CASE WHEN s_suppkey % 8 = 5 THEN 'Open; Verify per Vintage' ELSE 'Open' END AS licence FROM supplier)""",
    "manifests": """manifests AS (SELECT tile, CASE WHEN (s + tile) % 28 = 0 THEN printf('new%04d', s) ELSE printf('src%04d', s) END AS source_id,
        CASE WHEN s % 2 = 0 THEN 'input' ELSE 'target' END AS role, 'v' || (s % 5) AS version
        FROM (SELECT DISTINCT CAST(l_partkey % 40 AS INTEGER) AS tile, l_suppkey AS s FROM lineitem) WHERE (tile + s) % 4 = 0)""",
}
NEEDS = {"edges": ("ways",), "segments": ("nodes", "ways", "edges")}


def with_ctes(names: tuple[str, ...], select: str) -> str:
    """select with the relations it names, and those that they build on, as common table expressions."""
    wanted = [n for name in names for n in (*NEEDS.get(name, ()), name)]
    parts = [CTES[n] for n in dict.fromkeys(wanted)]
    more = select.lstrip()
    if more.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + more[15:]
    if more.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + more[5:]
    return "WITH " + ", ".join(parts) + " " + more
