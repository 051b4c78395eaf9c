"""Packing token sequences into windows by non-negative least squares over their length histogram.

A document's ids and its end id are cut into full windows and a rest, so every id is in exactly one
piece. The histogram of piece lengths (at most `window` numbers, whatever the input) goes to the
driver. There all pairs and triples of present lengths that fill a window, pairs also nearly, are
enumerated; projected gradient descent solves for non-negative repeat counts that use up the
histogram; the counts are rounded down, and what is left is packed greedily, longest first, each
gap taking the largest length that fits. The plan is a list of (length, range of ranks) ->
(sequences, offset). Pieces get their rank among those of equal length in two steps, within salted
shares and by the shares' counts, so that a length that a third of all pieces have is still dealt
over many tasks. The plan is joined by length and bucket of ranks, the buckets of a length being as
wide as its ranges are on average: over all pieces that is about two ranges tried for each. Its size
hangs on the window alone; it is broadcast below a bound, and joined by shuffle beyond it.

Edge cases: a null or empty text has the end id alone; the string of a special token in a text is that
token, as in the library; repeated rows are packed each; a text of any length is read whole; an empty
table gives no pieces; a null id is kept; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import id_field
from .common import FLUSH_BYTES, give_back, materialise, slices
from .tokens import piece_tokenizer

#: A plan of more bytes is joined by shuffle.
PLAN_BYTES = 64 << 20


def cut(docs: DataFrame, path: str, pattern: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: id_col, start, length, doc_tokens long, ids binary (little-endian unsigned 32-bit)."""
    schema = f"`{id_col}` {id_field(docs, id_col)}, start long, length long, doc_tokens long, ids binary"

    def run(batches):
        tokens = piece_tokenizer(path, pattern)
        tail = np.array([end_id], "<u4").tobytes()
        names = [id_col, "start", "length", "doc_tokens", "ids"]
        for batch in batches:
            kind = batch.schema.field(0).type
            out, held = [[] for _ in names], 0

            def made(out=out, kind=kind):
                kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

            for keys, texts in slices(batch, "k", "t"):
                for key, text in zip(keys, texts):
                    ids = tokens.ids(text) + tail
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        part = ids[4 * at : 4 * (at + window)]
                        for column, value in zip(out, (key, at, len(part) // 4, n, part)):
                            column.append(value)
                    held += len(ids)
                if held > FLUSH_BYTES:
                    yield made()
                    for column in out:
                        column.clear()
                    held = 0
            if out[0]:
                yield made()
        give_back()

    return docs.selectExpr(f"`{id_col}` as k", f"`{text_col}` as t").mapInArrow(run, schema)


def combinations(lengths: np.ndarray, window: int, slack: int = 16) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill the window; pairs may miss up to slack."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    found = []
    for gap in range(slack + 1):
        other = window - gap - lengths
        keep = (other >= lengths) & present[np.clip(other, 0, window)] & (other > 0)
        found.append(np.stack([lengths[keep], other[keep], 0 * lengths[keep]], 1))
    for a in lengths:
        b = lengths[(lengths >= a) & (window - a - lengths >= lengths)]
        c = window - a - b
        keep = present[c] & (c > 0)
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(found).astype(np.int32) if found else np.empty((0, 3), np.int32)


def nnls(combos: np.ndarray, target: np.ndarray, steps: int = 150) -> np.ndarray:
    """x >= 0 that minimises |A x - target|^2 for the incidence matrix A of the combinations.

    Accelerated projected gradient with a diagonal scale (each column's share of its rows' counts),
    A being applied by gathers and sums, so no matrix is ever held.
    """
    use = combos > 0
    flat = combos.ravel()
    degree = np.bincount(flat, minlength=len(target)).astype(float)
    degree[0] = 0
    scale = 1.0 / np.maximum(1.0, (degree[combos] * use).max(1) * 3)
    x = np.zeros(len(combos))
    y, momentum = x, 1.0
    for _ in range(steps):
        used = np.bincount(flat, np.repeat(y, 3), len(target))
        used[0] = 0
        error = used - target
        error[0] = 0
        new = np.maximum(0.0, y - scale * error[combos].sum(1))
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): rank r of a length is in sequence
    first sequence + r - first rank, at offset."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    used, rows, sequences = np.zeros(window + 1, np.int64), [], 0

    def take(parts: list[int], n: int) -> None:
        nonlocal sequences
        offset = 0
        for length in parts:
            rows.append((int(length), int(used[length]), int(n), sequences, offset))
            used[length] += n
            left[length] -= n
            offset += int(length)
        sequences += int(n)

    if left[window]:
        take([window], left[window])
    lengths = np.flatnonzero(left[1:window]) + 1
    combos = combinations(lengths, window)
    if len(combos):
        x = nnls(combos, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            parts = [int(v) for v in combos[k] if v]
            n = min(int(x[k]), *(int(left[v]) // parts.count(v) for v in parts))
            if n:
                take(parts, n)
    while len(there := np.flatnonzero(left)):
        parts, n, room = [], int(left[there[-1]]), window
        for length in there[::-1]:
            if length <= room:
                fits = min(room // int(length), int(left[length]))
                parts += [int(length)] * fits
                n = min(n, int(left[length]) // fits)
                room -= fits * int(length)
        take(parts, n)
    return rows


def bucketed(rows: list[tuple[int, int, int, int, int]]) -> tuple[pa.Table, pa.Table]:
    """The plan with a row for each bucket of ranks that a range meets, and the buckets' width by length."""
    held = np.array(rows, np.int64).reshape(-1, 5)
    length, first, count, sequence, offset = held.T
    of, where, ranges = np.unique(length, return_inverse=True, return_counts=True)
    pieces = np.bincount(where, count, len(of)).astype(np.int64)
    width = np.maximum(1, pieces // ranges)
    low, high = first // width[where], (first + count - 1) // width[where]
    times = high - low + 1
    at = np.repeat(np.arange(len(held)), times)
    bucket = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    names = ["_length", "_first", "_count", "_sequence", "_offset", "_bucket"]
    columns = [length[at], first[at], count[at], sequence[at], offset[at], bucket]
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names), pa.table([pa.array(of), pa.array(width)], ["_of", "_width"])


def assign(pieces: DataFrame, window: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """pieces (id_col, start, length and any payload) with sequence_id, offset long.

    pieces is read twice: hand over a table, or something cheap to compute again.
    """
    spark = pieces.sparkSession
    shares = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_share", F.pmod(F.xxhash64(id_col, "start"), F.lit(shares)))
    counts = salted.groupBy("length", "_share").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    dealt, widths = bucketed(plan(histogram, window))
    small = dealt.nbytes <= PLAN_BYTES
    dealt, widths = spark.createDataFrame(dealt), F.broadcast(spark.createDataFrame(widths))  # widths: a row for each length
    dealt = F.broadcast(dealt) if small else dealt
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy("length", "_share").orderBy(id_col, "start")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(inner) - 1)
        .join(offsets, ["length", "_share"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    ranked = ranked.join(widths, F.col("length") == F.col("_of")).withColumn("_own", F.floor(F.col("_rank") / F.col("_width")))
    here = (F.col("length") == F.col("_length")) & (F.col("_own") == F.col("_bucket"))
    placed = ranked.join(dealt, here & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")))
    return placed.select(*pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack(docs: DataFrame, path: str, pattern: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed pieces with their ids: id_col, start, length, doc_tokens, ids, sequence_id, offset."""
    return assign(materialise(cut(docs, path, pattern, window, end_id, id_col, text_col), "pieces"), window, id_col)
