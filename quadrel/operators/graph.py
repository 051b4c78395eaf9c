"""Road graphs as two tables, nodes (id, x, y) and edges (graph, id, u, v, ...), many graphs in one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the folder of spark.checkpoint.dir, its lineage cut."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="quadrel-")
        spark.conf.set("spark.checkpoint.dir", folder)  # one machine, as in tests
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the table that written() made for df, which nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ends(edges: DataFrame) -> DataFrame:
    """graph, node, id: each edge at each of its nodes; a loop once."""
    return edges.select("graph", "id", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("graph", "node").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """edges with a <= b, the unordered pair of their nodes."""
    return edges.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})


def shortest_parallel(edges: DataFrame, length: str = "length") -> DataFrame:
    """graph, a, b, length: of parallel edges the shortest; no loops."""
    return undirected(edges).where("u <> v").groupBy("graph", "a", "b").agg(F.min(length).alias(length))


def components(edges: DataFrame) -> DataFrame:
    """graph, node, root: the least node of each node's component.

    In a round every node points to its least neighbour, if that is less than itself; pointers are
    doubled until they end in nodes less than all of theirs, and the edges are contracted along them. At
    most half of the nodes are left for the next round, so rounds and doublings grow with the logarithm
    of the nodes. A component's least node is never contracted. In the end the pointers are followed
    backwards, from the last round to the first.
    """
    both = edges.select("graph", F.col("u").alias("node"), F.col("v").alias("other"))
    both = both.unionByName(edges.select("graph", F.col("v").alias("node"), F.col("u").alias("other"))).distinct()
    both, rounds = written(both, "adjacent"), []
    while not rounds or both.limit(1).count():
        to, moving = written(both.groupBy("graph", "node").agg(F.least(F.min("other"), "node").alias("root")), "pointers"), True
        while moving:
            jump = to.select("graph", F.col("node").alias("root"), F.col("root").alias("further"))
            new = written(to.join(jump, ["graph", "root"]).select("graph", "node", F.col("further").alias("root"), (F.col("further") < F.col("root")).alias("moved")), "pointers")
            moving = new.where("moved").limit(1).count() > 0
            discard(to)
            to = new
        rounds.append(to)
        to = to.drop("moved")
        moved = both.join(to, ["graph", "node"]).select("graph", F.col("root").alias("node"), "other")
        moved = moved.join(to.withColumnsRenamed({"node": "other", "root": "there"}), ["graph", "other"])
        last, both = both, written(moved.where("node <> there").select("graph", "node", F.col("there").alias("other")).distinct(), "adjacent")
        discard(last)
    discard(both)
    labels = rounds.pop().drop("moved")
    while rounds:
        further = labels.select("graph", F.col("node").alias("root"), F.col("root").alias("further"))
        labels = written(rounds.pop().join(further, ["graph", "root"], "left").select("graph", "node", F.coalesce("further", "root").alias("root")), "labels")
    return labels


def prune_spurs(edges: DataFrame, least: float, rounds: int = 3, length: str = "length") -> DataFrame:
    """edges without those shorter than `least` that end in a node of degree 1, round by round.

    A round reads what the last one wrote, so no plan grows with the rounds, and stops where nothing goes.
    """
    edges = written(edges, "edges")
    for _ in range(rounds):
        single = degrees(edges).where("degree = 1").select("graph", "node")
        short = ends(edges.where(F.col(length) < least)).join(single, ["graph", "node"], "left_semi")
        gone = written(short.select("graph", "id").distinct(), "spurs")
        if not gone.limit(1).count():
            break
        last, edges = edges, written(edges.join(gone, ["graph", "id"], "left_anti"), "edges")
        discard(last)
    return edges


def drop_small(edges: DataFrame, least: float, length: str = "length") -> DataFrame:
    """edges of the components that are at least `least` long in all."""
    roots = components(edges)
    placed = edges.join(roots.withColumnRenamed("node", "u"), ["graph", "u"])
    long = placed.groupBy("graph", "root").agg(F.sum(length).alias("_all")).where(F.col("_all") >= least).select("graph", "root")
    return placed.join(long, ["graph", "root"], "left_semi").select(*edges.columns)


def split_at(ways: DataFrame, junctions: DataFrame) -> DataFrame:
    """way, span, pos, ref: ways cut at junctions, which close one span and open the next.

    Gaps and islands: the running number of junctions before a reference is its span.
    """
    marked = ways.join(junctions.select("ref", F.lit(1).alias("cut")), "ref", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    order = Window.partitionBy("way").orderBy("pos")
    spans = marked.withColumn("span", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("span", F.coalesce("span", F.lit(0)))
    opened = spans.where("cut = 1").withColumn("span", F.col("span") + 1)
    both = spans.unionByName(opened)
    many = both.groupBy("way", "span").agg(F.count("*").alias("n")).where("n >= 2").select("way", "span")
    return both.join(many, ["way", "span"], "left_semi").select("way", "span", "pos", "ref")


def orientation_entropy(edges: DataFrame, bins: int = 36) -> DataFrame:
    """graph, entropy: of the length-weighted bearings folded to 180 degrees, as a share of the most."""
    by_bin = edges.withColumn("bin", F.least(F.floor(F.col("bearing") / (180.0 / bins)), F.lit(bins - 1))).groupBy("graph", "bin").agg(F.sum("length").alias("w"))
    whole = by_bin.groupBy("graph").agg(F.sum("w").alias("all"))
    share = F.col("w") / F.nullif(F.col("all"), F.lit(0.0))
    entropy = F.greatest(F.lit(0.0), -F.sum(F.when(share > 0, share * F.log(share)).otherwise(0.0)) / F.log(F.lit(float(bins))))
    return by_bin.join(whole, "graph").groupBy("graph").agg(entropy.alias("entropy"))
