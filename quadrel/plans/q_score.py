"""Queries over predicted probabilities: scores, thresholds, losses, perturbations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import relations as rel
from .catalog import query
from .catalog import rounded as r


def ratio(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0).cast("long")), F.lit(0.0))


def f1(tp, fp, fn):
    return F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0).cast("long")), F.lit(0.0))


COUNTS = "count(*) FILTER (p >= thr AND truth) AS tp, count(*) FILTER (p >= thr AND NOT truth) AS fp, count(*) FILTER (p < thr AND truth) AS fn"


def counted(rows, *by):
    hit = F.col("p") >= F.col("thr")
    return rows.groupBy(*by).agg(F.count_if(hit & F.col("truth")).alias("tp"), F.count_if(hit & ~F.col("truth")).alias("fp"), F.count_if(~hit & F.col("truth")).alias("fn"))


@query("scores", sql=f"""SELECT tile, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 5) AS prec, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 5) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 5) AS f1,
  round(coalesce(tp / nullif(tp + fp + fn, 0)::DOUBLE, 0), 5) AS iou FROM (SELECT tile, {COUNTS} FROM (SELECT *, 0.2::DOUBLE AS thr FROM scores WHERE valid) GROUP BY tile)""")
def a16_score(spark, sf_dir):
    c = counted(rel.scores(spark, sf_dir).where("valid").withColumn("thr", F.lit(0.2)), "tile")
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return c.select("tile", "tp", "fp", "fn", r(ratio(tp, tp + fp), 5).alias("prec"), r(ratio(tp, tp + fn), 5).alias("recall"), r(f1(tp, fp, fn), 5).alias("f1"), r(ratio(tp, tp + fp + fn), 5).alias("iou"))


@query("scores", sql=f"""WITH t AS (SELECT (i + 1) * 0.05::DOUBLE AS thr FROM range(19) t(i)), c AS (SELECT tile, thr, {COUNTS} FROM scores, t WHERE valid GROUP BY ALL)
  SELECT tile, round(thr, 2) AS thr, round(f, 5) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY round(f, 9) DESC, thr) AS k FROM (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f FROM c)) WHERE k = 1""")
def a17_best_threshold(spark, sf_dir):
    """Largest F1 of 19 thresholds, the first of equals.

    Rows are counted once, by the step that their probability reaches; thresholds read running sums.
    """
    s = rel.scores(spark, sf_dir).where("valid")
    steps = [(i + 1) * 0.05 for i in range(19)]
    reached = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: F.col("p") >= t))
    by = s.groupBy("tile", reached.alias("k")).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    arrays = by.groupBy("tile").agg(F.collect_list(F.struct("k", "pos", "neg")).alias("c"), F.sum("pos").alias("all"))
    total = lambda c, i, field: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.when(x["k"] > i, x[field]).otherwise(F.lit(0).cast("long")))
    each = arrays.select("tile", "all", "c", F.posexplode(F.array(*map(F.lit, steps))).alias("i", "thr"))
    each = each.withColumns({"tp": total(F.col("c"), F.col("i"), "pos"), "fp": total(F.col("c"), F.col("i"), "neg")})
    f = f1(F.col("tp"), F.col("fp"), F.col("all") - F.col("tp"))
    best = each.groupBy("tile").agg(F.max(F.struct((F.round(f + 1e-9, 9) + 0.0).alias("f"), (-F.col("thr")).alias("t"), f.alias("g"))).alias("m"))
    return best.select("tile", r(-F.col("m.t"), 2).alias("thr"), r("m.g", 5).alias("f1"))


@query("scores", sql="SELECT tile, round(sum(CASE WHEN truth THEN 1 ELSE 0 END) / count(*)::DOUBLE, 5) AS rate, round(avg(CASE WHEN p >= 0.2 THEN 1.0::DOUBLE ELSE 0 END), 5) AS coverage FROM scores WHERE valid GROUP BY tile")
def a18_road_rate(spark, sf_dir):
    """Share of positives, which is the constant prior (p33), and of the candidate mask (p32)."""
    s = rel.scores(spark, sf_dir).where("valid")
    return s.groupBy("tile").agg(r(F.avg(F.col("truth").cast("int")), 5).alias("rate"), r(F.avg((F.col("p") >= 0.2).cast("int")), 5).alias("coverage"))


@query("scores", sql="""SELECT tile, round(sum(CASE WHEN valid THEN greatest(x, 0) - x * t + ln(1 + exp(-abs(x))) + CASE WHEN truth THEN 2 * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) ELSE 0 END ELSE 0 END) / greatest(sum(CASE WHEN valid THEN 1 ELSE 0 END), 1), 5) AS bce,
  round(1 - (2 * sum(CASE WHEN valid THEN s * t ELSE 0 END) + 1) / (sum(CASE WHEN valid THEN s + t ELSE 0 END) + 1), 5) AS dice FROM (SELECT *, (p - 0.3) * 8 AS x, 1 / (1 + exp(-(p - 0.3) * 8)) AS s, CASE WHEN truth THEN 1.0::DOUBLE ELSE 0 END AS t FROM scores) GROUP BY tile""")
def n2_losses(spark, sf_dir):
    """Masked cross entropy from logits with weighted positives, and masked Dice; an empty mask gives 0."""
    x, t, m = (F.col("p") - 0.3) * 8, F.col("truth").cast("double"), F.col("valid").cast("double")
    soft = F.log1p(F.exp(-F.abs(x)))
    bce = F.greatest(x, F.lit(0.0)) - x * t + soft + 2 * t * (F.greatest(-x, F.lit(0.0)) + soft)
    s = 1 / (1 + F.exp(-x))
    got = rel.scores(spark, sf_dir).groupBy("tile")
    return got.agg(r(F.sum(m * bce) / F.greatest(F.sum(m), F.lit(1.0)), 5).alias("bce"), r(1 - (2 * F.sum(m * s * t) + 1) / (F.sum(m * (s + t)) + 1), 5).alias("dice"))


@query("stack", sql="SELECT site, cell, round(quantile_cont(v, 0.01), 3) AS lo, round(quantile_cont(v, 0.99), 3) AS hi FROM stack GROUP BY ALL")
def a22_observed_range(spark, sf_dir):
    s = rel.stack(spark, sf_dir).groupBy("site", "cell")
    return s.agg(r(F.percentile("v", 0.01), 3).alias("lo"), r(F.percentile("v", 0.99), 3).alias("hi"))


@query("stack", sql="SELECT tile, round(avg(greatest(0, least(200, v * 1.5))), 4) AS mean, round(avg(CASE WHEN v * 1.5 > 200 OR v * 1.5 < 0 THEN 1.0::DOUBLE ELSE 0 END), 5) AS clamped FROM stack GROUP BY tile")
def n6_perturbation(spark, sf_dir):
    """A channel scaled and clipped to its range, with the share that the clip changed."""
    v = F.col("v") * 1.5
    return rel.stack(spark, sf_dir).groupBy("tile").agg(r(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(200.0), v)))).alias("mean"), r(F.avg(((v > 200) | (v < 0)).cast("int")), 5).alias("clamped"))


@query("stack", sql="""WITH q AS (SELECT site, i.i AS level, quantile_cont(v, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) [i.i + 1] AS qv FROM stack, range(9) i(i) GROUP BY site, i.i),
  m AS (SELECT s.tile, s.cell, s.v, a.level, a.qv AS lo, b.qv AS hi, ra.qv AS rlo, rb.qv AS rhi, row_number() OVER (PARTITION BY s.tile, s.cell ORDER BY a.level) AS k FROM stack s JOIN q a ON a.site = s.site JOIN q b ON b.site = a.site AND b.level = a.level + 1 AND s.v >= a.qv AND s.v <= b.qv
    JOIN q ra ON ra.site = 0 AND ra.level = a.level JOIN q rb ON rb.site = 0 AND rb.level = b.level)
  SELECT tile, cell, round(rlo + (rhi - rlo) * coalesce((v - lo) / nullif(hi - lo, 0), 0), 3) AS mapped FROM m WHERE k = 1""")
def n7_quantile_map(spark, sf_dir):
    """Values moved from their site's distribution to a reference one, linearly between levels (j20).

    The levels of a site are an array on its rows; no cell is joined with a level.
    """
    s = rel.stack(spark, sf_dir)
    levels = F.array(*[F.lit(i / 8) for i in range(9)])
    q = s.groupBy("site").agg(F.percentile("v", levels).alias("q"))
    rows = s.join(F.broadcast(q), "site")  # one array a site
    ref = q.where("site = 0").select(F.col("q").alias("ref"), F.lit(1).alias("one"))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(ref), "one")
    k = F.greatest(F.array_position(F.transform(F.slice("q", 2, 8), lambda h: F.col("v") <= h), True).cast("int") - 1, F.lit(0))
    rows = rows.withColumn("k", k)
    at = lambda a, i: F.get(a, F.col("k") + i)
    share = F.coalesce((F.col("v") - at("q", 0)) / F.nullif(at("q", 1) - at("q", 0), F.lit(0.0)), F.lit(0.0))
    return rows.select("tile", "cell", r(at("ref", 0) + (at("ref", 1) - at("ref", 0)) * share, 3).alias("mapped"))


@query("stack", sql="""WITH a AS (SELECT tile, cell, v, row_number() OVER (PARTITION BY tile ORDER BY cell) AS k FROM stack), b AS (SELECT tile, v, row_number() OVER (PARTITION BY tile ORDER BY sha256('shuffle:' || tile || ':' || cell)) AS k FROM stack)
  SELECT a.tile, a.cell, b.v FROM a JOIN b USING (tile, k)""")
def n8_shuffle_channel(spark, sf_dir):
    """A channel's cells in an order drawn by hash (l9, w14)."""
    s = rel.stack(spark, sf_dir)
    key = F.sha2(F.concat_ws(":", F.lit("shuffle"), F.col("tile").cast("string"), F.col("cell").cast("string")), 256)
    own = Window.partitionBy("tile")  # a tile's cells of one channel: 64 here, a block in any case
    a = s.select("tile", "cell", F.row_number().over(own.orderBy("cell")).alias("k"))
    b = s.select("tile", "v", F.row_number().over(own.orderBy(key)).alias("k"))
    return a.join(b, ["tile", "k"]).select("tile", "cell", "v")


@query("stack", sql="""WITH m AS (SELECT site, quantile_cont(v, 0.5) AS med FROM stack GROUP BY site) SELECT site, round(med, 3) AS med, CASE WHEN med > h THEN 'up' WHEN med < h THEN 'down' ELSE 'flat' END AS expected FROM m, (SELECT med AS h FROM m WHERE site = 3)""")
def n9_quantile_arms(spark, sf_dir):
    """Reference sites as arms, with the change expected against the held-out site's median."""
    m = rel.stack(spark, sf_dir).groupBy("site").agg(F.percentile("v", 0.5).alias("med"))
    home = m.agg(F.max(F.when(F.col("site") == 3, F.col("med"))).alias("h")).withColumn("one", F.lit(1))
    rows = m.withColumn("one", F.lit(1)).join(F.broadcast(home), "one")
    return rows.select("site", r("med", 3).alias("med"), F.when(F.col("med") > F.col("h"), "up").when(F.col("med") < F.col("h"), "down").otherwise("flat").alias("expected"))


@query("scores", sql="""WITH q AS (SELECT tile, quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM scores GROUP BY tile), b AS (SELECT s.tile, CAST(CASE WHEN p < q[1] THEN 0 WHEN p < q[2] THEN 1 WHEN p < q[3] THEN 2 WHEN p < q[4] THEN 3 ELSE 4 END AS INTEGER) AS bin, truth FROM scores s JOIN q USING (tile))
  SELECT tile, bin, count(*) AS n, round(avg(CASE WHEN truth THEN 1.0::DOUBLE ELSE 0 END), 5) AS mean FROM b GROUP BY ALL""")
def a25_quintile_response(spark, sf_dir):
    """Mean response by fifth of the driver; bins are half open, the last closed."""
    s = rel.scores(spark, sf_dir)
    q = s.groupBy("tile").agg(F.percentile("p", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("q"))
    bin_ = F.size(F.filter("q", lambda x: F.col("p") >= x))
    return s.join(q, "tile").groupBy("tile", bin_.alias("bin")).agg(F.count("*").alias("n"), r(F.avg(F.col("truth").cast("int")), 5).alias("mean"))


@query("scores", sql="""WITH c AS (SELECT tile, count(*) FILTER (p >= 0.2 AND truth) AS tp, count(*) FILTER (p >= 0.2 AND NOT truth) AS fp, count(*) FILTER (p < 0.2 AND truth) AS fn, avg(CASE WHEN truth THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM scores WHERE valid GROUP BY tile),
  f AS (SELECT tile, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, 2 * rate / (1 + rate) AS prior FROM c) SELECT tile, CASE WHEN f1 > prior AND f1 > 0.15 THEN 'PASS' WHEN f1 > prior OR f1 > 0.15 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM f""")
def p42_verdict(spark, sf_dir):
    """A model against two priors: all positive, and a fixed one."""
    s = rel.scores(spark, sf_dir).where("valid").withColumn("thr", F.lit(0.2))
    rate = s.groupBy("tile").agg(F.avg(F.col("truth").cast("double")).alias("rate"))
    c = counted(s, "tile").join(rate, "tile").withColumns({"f": f1(F.col("tp"), F.col("fp"), F.col("fn")), "prior": 2 * F.col("rate") / (1 + F.col("rate"))})
    first, second = F.col("f") > F.col("prior"), F.col("f") > 0.15
    return c.select("tile", F.when(first & second, "PASS").when(first | second, "PARTIAL").otherwise("FAIL").alias("verdict"))


@query("scores", sql="""SELECT tile, printf('%-6s P=%.3f n=%d', 't' || tile, round(avg(p), 6), count(*)) AS line, regexp_replace(lower('Tile ' || tile || ' (a/b)'), '[^a-z0-9]+', '_', 'g') AS slug FROM scores GROUP BY tile""")
def m40_report_lines(spark, sf_dir):
    """Fixed-width lines and slugs (m41)."""
    s = rel.scores(spark, sf_dir).groupBy("tile").agg((F.round(F.avg("p") + 1e-9, 6) + 0.0).alias("p"), F.count("*").alias("n"))
    name = F.concat(F.lit("t"), F.col("tile").cast("string"))
    return s.select("tile", F.format_string("%-6s P=%.3f n=%d", name, F.col("p"), F.col("n")).alias("line"), F.regexp_replace(F.lower(F.concat(F.lit("Tile "), F.col("tile").cast("string"), F.lit(" (a/b)"))), "[^a-z0-9]+", "_").alias("slug"))
