"""Rank statistics over observations: Spearman by pair of measures, cluster bootstrap, verdicts.

Ranks are window functions over one (feature, metric) pair's rows; a pair with very many rows would
be one window partition, so for those ranked() counts values first and ranks the distinct values'
counts, which a running sum over pre-aggregated counts gives.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivoted(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def pairs(observations: DataFrame, features: list[str], metrics: list[str]) -> DataFrame:
    """feature, metric, tile, site, x, y: pairwise complete observations.

    Every row is exploded over features and metrics; nothing is joined.
    """
    f = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in features])
    m = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("y")) for c in metrics])
    rows = observations.select("tile", "site", F.inline(f), m.alias("m")).where("x is not null")
    return rows.select("tile", "site", "feature", "x", F.inline("m")).where("y is not null")


def average_rank(values: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """by, value, out: the average rank of each distinct value, from the counts of values."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(value)) - F.col("_n")
    return counts.select(*by, value, (before + (F.col("_n") + 1) / F.lit(2.0)).alias(out))


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with rx, ry."""
    return rows.join(average_rank(rows, by, "x", "rx"), [*by, "x"]).join(average_rank(rows, by, "y", "ry"), [*by, "y"])


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r of sums; null where a side doesn't vary."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return (n * sxy - sx * sy) / F.nullif(F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy).otherwise(0.0)), F.lit(0.0))


def spearman(rows: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """by, n, clusters, rho: null below `least` rows or without variance."""
    sums = ranked(rows, by).groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("site").alias("clusters"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"),
        F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy"), F.sum(F.col("rx") * F.col("ry")).alias("sxy"),
    )
    rho = F.when(F.col("n") >= least, correlation(*map(F.col, ("n", "sx", "sy", "sxx", "syy", "sxy"))))
    return sums.select(*by, "n", "clusters", rho.alias("rho"))


def draws(sites: list, iterations: int, seed: str = "draw") -> dict[tuple[int, ...], int]:
    """How often each site is drawn, with replacement, in a draw of as many as there are -> draws of that kind.

    A draw is a hash of seed, iteration and slot, so any engine can repeat it. Only the counts of a draw
    matter; a few sites have few of those, however many iterations there are.
    """
    n, found = len(sites), Counter()
    for i in range(iterations):
        times = [0] * n
        for slot in range(n):
            times[int(hashlib.sha256(f"{seed}:{i}:{slot}".encode()).hexdigest()[:12], 16) % n] += 1
        found[tuple(times)] += 1
    return dict(found)


def site_ranks(rows: DataFrame, by: list[str], value: str, out: str, sites: list) -> DataFrame:
    """by, value, out: for each site its rows below a value and half of those with it.

    The average rank of a value among rows that weigh as often as their site was drawn is the sum of
    these, each times its site's draws, and a half: no draw sorts or counts anything anew.
    """
    counted = rows.groupBy(*by, value).agg(*[F.count_if(F.col("site") == F.lit(x)).alias(f"_n{k}") for k, x in enumerate(sites)])
    upto = Window.partitionBy(*by).orderBy(value)
    return counted.select(*by, value, F.array(*[F.sum(f"_n{k}").over(upto) - F.col(f"_n{k}") / F.lit(2.0) for k in range(len(sites))]).alias(out))


def bootstrap(rows: DataFrame, sites: list, by: list[str], iterations: int, least_clusters: int = 3, seed: str = "draw") -> DataFrame:
    """by, lo, hi: the 95 % interval of rho when whole sites are drawn; null with too few of either.

    sites: their list, a dimension. A row meets each kind of draw once, in place, and is added up there.
    """
    kinds = draws(sites, iterations, seed)
    dealt = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(n).cast("long").alias("times"), F.array(*[F.lit(float(x)) for x in w]).alias("w")) for i, (w, n) in enumerate(sorted(kinds.items()))])
    ranked_ = rows.join(site_ranks(rows, by, "x", "px", sites), [*by, "x"]).join(site_ranks(rows, by, "y", "py", sites), [*by, "y"])
    own = F.array_position(F.array(*map(F.lit, sites)), F.col("site")).cast("int") - 1
    each = ranked_.select(*by, own.alias("own"), "px", "py", F.inline(dealt))
    dot = lambda p: sum((F.get(p, F.lit(k)) * F.get("w", F.lit(k)) for k in range(len(sites))), F.lit(0.5))
    each = each.select(*by, "kind", "times", F.get("w", F.col("own")).alias("m"), dot("px").alias("rx"), dot("py").alias("ry")).where("m > 0")
    w, x, y = F.col("m"), F.col("rx"), F.col("ry")
    sums = each.groupBy(*by, "kind", "times").agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
    )
    rho = sums.select(*by, "times", F.when(F.col("n") >= 3, correlation(*map(F.col, ("n", "sx", "sy", "sxx", "syy", "sxy")))).alias("rho")).where("rho is not null")
    ends = rho.groupBy(*by).agg(F.sum("times").alias("k"), F.percentile("rho", F.array(F.lit(0.025), F.lit(0.975)), F.col("times")).alias("p"))
    enough = rows.groupBy(*by).agg(F.countDistinct("site").alias("clusters")).where(F.col("clusters") >= least_clusters).select(*by)
    return ends.where(F.col("k") >= iterations // 4).join(enough, by, "left_semi").select(*by, F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))


def verdict(rho: Column, lo: Column, hi: Column, near: float = 0.3) -> Column:
    return (
        F.when(rho.isNull() | lo.isNull() | hi.isNull(), "insufficient")
        .when((lo > 0) | (hi < 0), "supported")
        .when((lo >= -near) & (hi <= near), "null")
        .otherwise("inconclusive")
    )
