"""Connected components of an edge table, by alternating large and small stars.

Edge cases: loops and repeated edges say nothing; nodes without another are in no row; ids may be of any
type that sorts; a null end links nothing; an empty table gives an empty result.

Nothing but the edge table itself is kept between rounds, written to the shared folder; a node that
touches a large part of all edges is a skewed join key, which adaptive execution splits, and its
minimum is pre-aggregated on the map side. The number of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node of an edge with the smallest node that it reaches."""
    own = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    own = materialise(own, "edges")
    seen = _fingerprint(own)
    while seen[0]:  # no edge: nothing to do
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, own = own, materialise(small.distinct(), "edges")
        discard(last)  # a round needs no more than the one before
        now = _fingerprint(own)
        if now == seen:
            break
        seen = now
    return own.select(F.col("u").alias("node"), F.col("v").alias("root"))
