"""Queries of the rank-correlation study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import study as S
from . import relations as rel
from .catalog import query
from .catalog import rounded as r

FEATURES, METRICS = ["f_balance", "f_step", "f_flat"], ["m_orders", "m_top", "m_ring"]
BY = ["feature", "metric"]
PAIRS = """f AS (SELECT tile, site, unnest(['f_balance', 'f_step', 'f_flat']) AS feature, unnest([f_balance, f_step, f_flat]) AS x, m_orders, m_top, m_ring FROM observations),
  pairs AS (SELECT * FROM (SELECT tile, site, feature, x, unnest(['m_orders', 'm_top', 'm_ring']) AS metric, unnest([m_orders, m_top, m_ring]) AS y FROM f) WHERE x IS NOT NULL AND y IS NOT NULL)"""
RANKS = PAIRS + """, ranks AS (SELECT *, rank() OVER (PARTITION BY feature, metric ORDER BY x) + (count(*) OVER (PARTITION BY feature, metric, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY feature, metric ORDER BY y) + (count(*) OVER (PARTITION BY feature, metric, y) - 1) / 2.0::DOUBLE AS ry FROM pairs)"""
RHO = RANKS + """, rho AS (SELECT feature, metric, count(*) AS n, count(DISTINCT site) AS clusters, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS rho FROM ranks GROUP BY ALL)"""
ITERATIONS = 2000
# draws that pick the sites equally often are one kind, weighted by their number; in a kind a row counts as often as its site is drawn
DRAWS = f"""sites AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT site FROM observations)),
  draw AS (SELECT i.i AS iteration, ('0x' || substr(sha256('draw:' || i.i || ':' || s.k), 1, 12))::BIGINT % s.n AS k FROM range({ITERATIONS}) i(i), sites s),
  times AS (SELECT iteration, site, count(*) AS w FROM draw JOIN sites USING (k) GROUP BY ALL), named AS (SELECT iteration, string_agg(site || 'x' || w, ',' ORDER BY site) AS kind FROM times GROUP BY iteration),
  kinds AS (SELECT kind, count(*) AS times, min(iteration) AS iteration FROM named GROUP BY kind), drawn AS (SELECT kind, k.times, site, w FROM kinds k JOIN times USING (iteration))"""
BOOT = RHO + f""", {DRAWS}, b AS (SELECT p.feature, p.metric, d.kind, d.times, p.x, p.y, d.w::DOUBLE AS w FROM pairs p JOIN drawn d USING (site)),
  br AS (SELECT *, sum(w) OVER (PARTITION BY feature, metric, kind ORDER BY x) - (sum(w) OVER (PARTITION BY feature, metric, kind, x) - 1) / 2 AS rx,
    sum(w) OVER (PARTITION BY feature, metric, kind ORDER BY y) - (sum(w) OVER (PARTITION BY feature, metric, kind, y) - 1) / 2 AS ry FROM b),
  bs AS (SELECT feature, metric, kind, times, min(rx) < max(rx) AND min(ry) < max(ry) AS varies, sum(w) AS n, sum(w * rx) AS sx, sum(w * ry) AS sy, sum(w * rx * rx) AS sxx, sum(w * ry * ry) AS syy, sum(w * rx * ry) AS sxy FROM br GROUP BY ALL),
  bi AS (SELECT feature, metric, unnest(range(times)) AS again, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS rho FROM bs WHERE varies AND n >= 3),
  ci AS (SELECT feature, metric, quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi FROM bi GROUP BY ALL HAVING count(rho) >= {ITERATIONS // 4}),
  study AS (SELECT r.*, lo, hi, CASE WHEN rho IS NULL OR lo IS NULL THEN 'insufficient' WHEN lo > 0 OR hi < 0 THEN 'supported' WHEN lo >= -0.3 AND hi <= 0.3 THEN 'null' ELSE 'inconclusive' END AS verdict FROM rho r LEFT JOIN ci USING (feature, metric))"""


def pairs(spark, sf_dir):
    return S.pairs(rel.observations(spark, sf_dir), FEATURES, METRICS)


def study(spark, sf_dir):
    """feature, metric, n, clusters, rho, lo, hi, verdict."""
    rows = pairs(spark, sf_dir)
    sites = sorted(x["site"] for x in rel.observations(spark, sf_dir).select("site").distinct().collect())  # a dimension
    ends = S.bootstrap(rows, sites, BY, ITERATIONS)
    found = S.spearman(rows, BY).join(ends, BY, "left")
    return found.withColumn("verdict", S.verdict(F.col("rho"), F.col("lo"), F.col("hi")))


@query("observations", sql="SELECT tile, m_ring, rank() OVER (ORDER BY m_ring) + (count(*) OVER (PARTITION BY m_ring) - 1) / 2.0::DOUBLE AS rk FROM observations")
def w1_average_rank(spark, sf_dir):
    o = rel.observations(spark, sf_dir).withColumn("one", F.lit(1))
    return o.join(S.average_rank(o, ["one"], "m_ring", "rk"), ["one", "m_ring"]).select("tile", "m_ring", "rk")


@query("observations", sql=f"WITH {PAIRS} SELECT feature, metric, count(*) AS n, round(sum(x * y), 1) AS xy FROM pairs GROUP BY ALL")
def j17_feature_metric_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy(*BY).agg(F.count("*").alias("n"), r(F.sum(F.col("x") * F.col("y")), 1).alias("xy"))


@query("observations", sql=f"WITH {RHO} SELECT feature, metric, n, clusters, round(rho, 5) AS rho FROM rho")
def a14_spearman(spark, sf_dir):
    return S.spearman(pairs(spark, sf_dir), BY).withColumn("rho", r("rho", 5))


@query("observations", sql=f"WITH {BOOT} SELECT feature, metric, round(lo, 4) AS lo, round(hi, 4) AS hi FROM study WHERE lo IS NOT NULL")
def a15_cluster_bootstrap(spark, sf_dir):
    return study(spark, sf_dir).where("lo is not null").select(*BY, r("lo").alias("lo"), r("hi").alias("hi"))


@query("observations", sql=f"WITH {BOOT} SELECT feature, metric, n, clusters, round(rho, 4) AS rho, verdict, CAST(row_number() OVER (ORDER BY round(abs(coalesce(rho, 0)), 6) DESC, feature, metric) AS INTEGER) AS place FROM study")
def t1_ranked_study(spark, sf_dir):
    """All findings with their verdicts (p41), strongest first."""
    strength = F.round(F.abs(F.coalesce("rho", F.lit(0.0))) + 1e-9, 6) + 0.0
    order = Window.orderBy(F.desc(strength), "feature", "metric")  # one row for each pair of measures
    return study(spark, sf_dir).withColumn("place", F.row_number().over(order)).select(*BY, "n", "clusters", r("rho").alias("rho"), "verdict", "place")


@query("observations", sql=f"WITH {BOOT}, k AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY round(abs(coalesce(rho, 0)), 6) DESC, feature, metric) AS place, count(*) OVER (PARTITION BY verdict) AS whole FROM study) SELECT verdict, feature, metric, CAST(place AS INTEGER) AS place, CASE WHEN place = 2 AND whole > 2 THEN printf('and %d more', whole - 2) ELSE '' END AS note FROM k WHERE place <= 2")
def t2_study_report(spark, sf_dir):
    strength = F.round(F.abs(F.coalesce("rho", F.lit(0.0))) + 1e-9, 6) + 0.0
    by = Window.partitionBy("verdict")
    k = study(spark, sf_dir).withColumns({"place": F.row_number().over(by.orderBy(F.desc(strength), "feature", "metric")), "whole": F.count("*").over(by)}).where("place <= 2")
    note = F.when((F.col("place") == 2) & (F.col("whole") > 2), F.format_string("and %d more", F.col("whole") - 2)).otherwise("")
    return k.select("verdict", *BY, "place", note.alias("note"))


@query("observations", sql="SELECT site, round(quantile_cont(m_orders, 0.5), 3) AS median_orders, round(avg(m_top), 2) AS mean_top, count(*) FILTER (m_orders IS NULL) AS missing FROM observations GROUP BY site")
def a20_site_medians(spark, sf_dir):
    """Site measures that skip what is unknown (a23)."""
    o = rel.observations(spark, sf_dir).groupBy("site")
    return o.agg(r(F.percentile("m_orders", 0.5), 3).alias("median_orders"), r(F.avg("m_top"), 2).alias("mean_top"), F.count_if(F.col("m_orders").isNull()).alias("missing"))


@query("observations", sql="WITH m AS (SELECT site, avg(f_balance) AS p, avg(m_ring) AS q FROM observations GROUP BY site) SELECT site, CAST(rank() OVER (ORDER BY p, site) AS INTEGER) AS by_p, CAST(rank() OVER (ORDER BY q, site) AS INTEGER) AS by_q FROM m")
def a21_site_ordering(spark, sf_dir):
    m = rel.observations(spark, sf_dir).groupBy("site").agg(F.avg("f_balance").alias("p"), F.avg("m_ring").alias("q"))
    return m.select("site", F.rank().over(Window.orderBy("p", "site")).alias("by_p"), F.rank().over(Window.orderBy("q", "site")).alias("by_q"))


@query("observations", sql="""WITH m AS (SELECT site, sum(m_orders) / nullif(sum(f_step), 0) AS ratio FROM observations GROUP BY site) SELECT site, round(ratio, 4) AS ratio, ratio BETWEEN 0.5 AND 2 AS plausible,
  CASE WHEN ratio IS NULL THEN 'n/a' WHEN abs(ratio - 1) < 0.05 THEN 'flat' WHEN ratio > 1 THEN 'up' ELSE 'down' END AS direction FROM m""")
def p38_agreement(spark, sf_dir):
    """Ratio of two measures, whether it is plausible (p39), and its direction with a dead band (p40)."""
    ratio = F.try_divide(F.sum("m_orders"), F.sum("f_step"))
    m = rel.observations(spark, sf_dir).groupBy("site").agg(ratio.alias("ratio"))
    way = F.when(F.col("ratio").isNull(), "n/a").when(F.abs(F.col("ratio") - 1) < 0.05, "flat").when(F.col("ratio") > 1, "up").otherwise("down")
    return m.select("site", r("ratio").alias("ratio"), F.col("ratio").between(0.5, 2).alias("plausible"), way.alias("direction"))


@query("observations", sql="""SELECT tile, site, CASE WHEN m_orders IS NULL THEN 'no metrics' WHEN f_balance < 0 THEN 'low coverage' ELSE '' END AS skipped FROM observations""")
def j16_observe(spark, sf_dir):
    """Tiles with the reason for which they are left out (a30, i8), if they are."""
    reason = F.when(F.col("m_orders").isNull(), "no metrics").when(F.col("f_balance") < 0, "low coverage").otherwise("")
    return rel.observations(spark, sf_dir).select("tile", "site", reason.alias("skipped"))


@query("observations", sql="SELECT site, tile, m_orders FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY m_orders DESC, tile) AS k FROM observations WHERE m_orders > 0) WHERE k = 1")
def t6_best_tile(spark, sf_dir):
    """One aggregate a site: the largest, and of equals the first."""
    o = rel.observations(spark, sf_dir).where("m_orders > 0")
    return o.groupBy("site").agg(F.max(F.struct("m_orders", (-F.col("tile")).alias("k"))).alias("m")).select("site", (-F.col("m.k")).alias("tile"), "m.m_orders")
