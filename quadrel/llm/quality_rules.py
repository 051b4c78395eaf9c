"""Quality rules: exact counts of a text, and a hashed n-gram likelihood ratio against a trusted target.

The tokens of a text are its runs of letters, digits and _ and its runs of other visible characters.
Its features are all tokens and all pairs of neighbours, each hashed to one of `buckets`. Over all
documents one multinomial is counted, over those that the caller trusts another; both are smoothed
by `alpha` a bucket. A document's score is the sum of log(trusted / all) over its features divided
by their number; it stays if that is at least `threshold`. The logarithms are rounded to 2**-20 and
summed as whole numbers, so the order of a sum can't change a verdict.

Everything is DataFrame functions. Features are exploded, one narrow row each, and counted by bucket
before their shuffle; the weights are a table of at most `buckets` rows that the features are joined
with, broadcast as that bounds it, and a document's sum is formed before its shuffle too. So the
driver holds nothing of the corpus. Ids are broadcast only below a measured size, and joined by
shuffle beyond it.

Edge cases: a null text has no words and no lines; fewer than ten words fail the base rules; without
any trusted text no ratio is known, and the base rules alone decide; a text without tokens has the
ratio 0; a trusted id that several rows share makes each of them trusted; repeated rows get the same
result each; a text of any length is read whole, its words being one array; an empty table gives an
empty result; columns other than those named are kept by passing and ignored else, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, once

SPACE, SCALE = r"[ \t-\r]+", 1 << 20


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    alpha: float = 1.0
    threshold: float = -0.2


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def following(array: str, k: int) -> Column:
    """The array without its first k elements."""
    return F.slice(array, F.lit(k + 1), F.greatest(F.size(array) - k, F.lit(0)))


def mixed(a: Column, b: Column, k: int) -> Column:
    """One 64-bit number of two, that of the second being k places on."""
    return a.bitwiseXOR(F.shiftleft(b, k))


def base_counts(rows: DataFrame, t: str = "_t") -> DataFrame:
    """rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; t: no nulls.

    Equal windows have equal numbers of 64 bits, mixed from their words' hashes: twos, then fours,
    then fives. So only texts in which a number occurs twice can hold a window twice; those are
    searched by the windows' words themselves. What other columns refer to by element is computed once,
    or Catalyst may put its making in place of a reference, which is then made for each element.
    """
    paired = lambda array, other, k: F.zip_with(array, following(other, k), lambda a, b: mixed(a, b, k))
    windows = F.when(F.size("_words") > 5, F.slice(paired("_fours", "_hashes", 4), F.lit(1), F.size("_words") - 4))
    keyed = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_windows") - 1), lambda p: F.struct(F.concat_ws(" ", *[F.get("_words", p + i) for i in range(5)]).alias("k"), p.alias("p")))),
    )
    same = lambda x, j: F.coalesce(F.get("_keyed", j)["k"] == x["k"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("_keyed", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))
    none = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate("_twice", none, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    long = lambda c: c.cast("long")
    return (
        rows.withColumn("_words", once(words_of(F.col(t))))
        .withColumn("_lines", lines)
        .withColumn("_hashes", once(F.transform("_words", lambda w: F.xxhash64(w))))
        .withColumn("_twos", paired("_hashes", "_hashes", 1))
        .withColumn("_fours", paired("_twos", "_twos", 2))
        .withColumn("_windows", once(windows))
        .withColumn("_keyed", once(keyed))
        .withColumn("_twice", once(twice))
        .withColumns(
            {
                "n_words": long(F.size("_words")),
                "word_chars": long(F.length(F.array_join("_words", ""))),
                "n_symbols": long(F.length(F.regexp_replace(t, "[^#*$%&|<>]+", ""))),
                "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
                "n_repeat_words": long(F.coalesce(covered, F.lit(0))),
            }
        )
        .drop("_words", "_lines", "_hashes", "_twos", "_fours", "_windows", "_keyed", "_twice")
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def tokens_of(t: str) -> Column:
    return F.regexp_extract_all(F.col(t), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))


def features(rows: DataFrame, s: Settings, t: str, *keys: str) -> DataFrame:
    """keys, bucket: a row for each token and each pair of neighbours; hashed in generated code."""
    lists = rows.select(*keys, tokens_of(t).alias("_tokens"))
    seen = lists.select(*keys, F.inline(F.arrays_zip(F.col("_tokens").alias("a"), following("_tokens", 1).alias("b"))))
    both = F.array(F.xxhash64("a"), F.when(F.col("b").isNotNull(), mixed(F.xxhash64("a"), F.xxhash64("b"), 1)))
    return seen.select(*keys, F.explode(both).alias("x")).where("x is not null").select(*keys, F.pmod("x", F.lit(s.buckets)).cast("int").alias("bucket"))


def fit(docs: DataFrame, trusted: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, weight: log(trusted / all) in units of 1 / SCALE, of each bucket that documents have.

    trusted: a table of ids. Without a feature in trusted texts all weights are 0.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(1))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(broadcast_if_small(ids, 16), "_id", "left")
    rows = rows.select("_t", F.coalesce("_trusted", F.lit(0)).alias("own"))
    counted = materialise(features(rows, s, "_t", "own").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("own").alias("own")), "buckets")
    total = counted.agg(F.sum("n").alias("n"), F.sum("own").alias("own")).first()
    n, own = total["n"] or 0, total["own"] or 0
    share = lambda c, all_: F.log(F.col(c) + F.lit(s.alpha)) - F.log(F.lit(all_ + s.alpha * s.buckets))
    weight = F.rint((share("own", own) - share("n", n)) * SCALE).cast("long") if own else F.lit(0).cast("long")
    return counted.select("bucket", weight.alias("weight"))


def ratios(docs: DataFrame, trusted: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """_id, _hash (of the text), llr: the mean weight of each document's features, if it has any."""
    weights = F.broadcast(fit(docs, trusted, s, id_col, text_col))  # at most `buckets` rows
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_hash", once(F.xxhash64("_t")))
    # rows that agree in id and text are one group here, with twice the sum and twice the number
    summed = features(rows, s, "_t", "_id", "_hash").join(weights, "bucket").groupBy("_id", "_hash").agg(F.sum("weight").alias("_sum"), F.count("*").alias("_n"))
    return summed.select("_id", "_hash", (F.col("_sum") / (F.col("_n") * F.lit(float(SCALE)))).alias("llr"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def judged(docs: DataFrame, trusted: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """_own (the id), _text (the text's hash) and COUNTS of each row of docs."""
    rows = docs.select(F.col(id_col).alias("_own"), text_of(text_col).alias("_t"))
    counted = base_counts(rows).withColumn("_text", F.xxhash64("_t")).drop("_t")
    found = ratios(docs, trusted, s, id_col, text_col)
    joined = counted.join(found, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    joined = joined.withColumn("llr", F.coalesce("llr", F.lit(0.0)))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= s.threshold)).select("_own", "_text", *COUNTS)


def judge(docs: DataFrame, trusted: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and COUNTS of each row of docs."""
    return judged(docs, trusted, s, id_col, text_col).select(F.col("_own").alias(id_col), *COUNTS)


def passing(docs: DataFrame, trusted: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with docs' columns as they were."""
    verdicts = materialise(judged(docs, trusted, s, id_col, text_col).select("_own", "_text", "kept"), "verdicts")
    gone = verdicts.where(~F.col("kept")).select("_own", "_text").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("__own"), F.xxhash64(text_of(text_col)).alias("__text"))
    left = rows.join(broadcast_if_small(gone, 24), F.col("__own").eqNullSafe(F.col("_own")) & (F.col("__text") == F.col("_text")), "left_anti")
    return left.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
