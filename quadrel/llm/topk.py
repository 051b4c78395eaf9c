"""Exact top-k inner products from an impact-ordered index, score at a time.

Components become whole numbers, floor(scale * x). The candidates of a partition are indexed in
blocks: for each component the rows are split into segments of equal quantised value. A query takes
the segments by descending impact, the largest part of a score that a row can get from one, and adds
that segment's quantised part to the sums of its rows. What the segments still left can add or take
away at most bounds every row's score from both sides; as soon as the rows whose upper bound reaches
the k-th best lower bound are few, or no segment is left, those possible members are scored exactly.
Rows are only ever dropped on that proof, so the result is exact.

Queries go to the executors in blocks of bounded size, each against all rows; what a partition
returns is k rows for each query, and the k best of those are ranked.

Edge cases: null vectors and vectors that hold null or non-finite components take no part; absent
components of shorter vectors count as 0; rows that have the query's own id are never its results;
repeated query rows are asked once; ties go to the smaller id, and repeated rows are results each;
with fewer than k candidates all are given; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK, QUERIES, LEVELS, FEW, CHECKS = 32768, 2048, 8, 64, 8


def whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v array<long>, of the vectors that take part."""
    odd = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(~odd)
    return usable.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(scale * x.cast("double"))).alias("v"))


def matrix(lists: list, width: int) -> np.ndarray:
    if all(len(x) == width for x in lists):
        return np.array(lists, np.int64).reshape(len(lists), width)
    made = np.zeros((len(lists), width), np.int64)
    for row, values in zip(made, lists):
        row[: min(width, len(values))] = values[:width]
    return made


class Index:
    """Segments of one block's rows: for each component, the rows of each quantised value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS):
        self.ids, self.rows = ids, rows
        self.members: list[np.ndarray] = []
        where, low, high = [], [], []
        for j in range(rows.shape[1]):
            column = rows[:, j]
            order = np.argsort(column, kind="stable").astype(np.int32)
            step = max(1, -(-(int(column.max()) - int(column.min()) + 1) // levels))
            level = (column[order] - column.min()) // step
            for part in np.split(order, np.flatnonzero(np.diff(level)) + 1):
                self.members.append(part)
                where.append(j)
                low.append(column[part[0]])
                high.append(column[part[-1]])
        self.where, self.low, self.high = np.array(where, np.int64), np.array(low, np.int64), np.array(high, np.int64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of all that may be among the k best and a few more, scored exactly."""
        weight = query[self.where]
        least, most = np.minimum(weight * self.low, weight * self.high), np.maximum(weight * self.low, weight * self.high)
        impact = np.maximum(np.abs(least), np.abs(most))
        order = np.argsort(-impact, kind="stable")
        # after t segments: what those left can add to a row, and take from it, at most, over all components
        dims = len(query)
        middle = (least + most) // 2
        spread = np.zeros(dims, np.int64)
        np.maximum.at(spread, self.where, np.maximum(most - middle, middle - least))
        error = int(spread.sum())
        sums = np.zeros(len(self.ids), np.int64)
        ends = np.linspace(0, len(order), CHECKS + 1).astype(int)[1:]
        at = 0
        mine = self.ids == own
        for end in ends:
            for seg in order[at:end]:
                sums[self.members[seg]] += middle[seg]
            at = end
            left = order[end:]
            gain, loss = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
            np.maximum.at(gain, self.where[left], most[left])
            np.minimum.at(loss, self.where[left], least[left])
            free = np.where(mine, np.iinfo(np.int64).min // 2, sums)
            if len(free) > k:
                worst = np.partition(free, len(free) - k)[len(free) - k] - error + int(loss.sum())
                may = np.flatnonzero(free + error + int(gain.sum()) >= worst)
            else:
                may = np.arange(len(free))
            if len(may) <= FEW:
                break
        may = may[~mine[may]]
        scores = self.rows[may] @ query
        best = np.lexsort((self.ids[may], -scores))[:k]
        return self.ids[may][best], scores[best]


def topk(vectors: DataFrame, chosen: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the k best rows for each chosen one."""
    rows = whole(vectors, id_col, vec_col, scale)
    asked = whole(vectors.where(chosen), id_col, vec_col, scale).dropDuplicates()
    blocks = max(1, -(-asked.count() // QUERIES))
    found = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # about QUERIES rows
        if not some and found is not None:
            continue
        part = best_of(rows, [r["id"] for r in some], [r["v"] for r in some], k)
        part = materialise(part, "topk") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "nr").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(rows: DataFrame, ids: list[int], queries: list[list[int]], k: int) -> DataFrame:
    """query_id, nr, vec_id, score: for each query the k best of each block of rows."""
    width = max(map(len, queries), default=0)
    sent = rows.sparkSession.sparkContext.broadcast((ids, matrix(queries, width)))  # QUERIES vectors at most

    def run(batches):
        own, asked = sent.value

        def answer(held_ids, held):
            index = Index(np.array(held_ids, np.int64), np.concatenate(held)) if width else None
            out = []
            for nr, (query_id, query) in enumerate(zip(own, asked)):
                if index is None:
                    keep = sorted(i for i in held_ids if i != query_id)[:k]
                    found, scores = np.array(keep, np.int64), np.zeros(len(keep), np.int64)
                else:
                    found, scores = index.top(query, query_id, k)
                out.append((np.full(len(found), query_id), np.full(len(found), nr), found, scores))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "nr", "vec_id", "score"])

        held_ids, held = [], []
        for batch in batches:
            for at in range(0, batch.num_rows if own else 0, 4096):
                part = batch.slice(at, 4096)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                lengths = np.diff(lists.offsets.to_numpy())
                same = len(flat) == part.num_rows * width and (lengths == width).all()
                held.append(flat.reshape(-1, width) if same else matrix(lists.to_pylist(), width))
                held_ids += part.column(0).to_pylist()
                if len(held_ids) >= BLOCK:
                    yield answer(held_ids, held)
                    held_ids, held = [], []
        if held_ids:
            yield answer(held_ids, held)

    return rows.select("id", "v").mapInArrow(run, "query_id long, nr long, vec_id long, score long")
