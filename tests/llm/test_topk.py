from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quadrel.llm import topk


def truth(rows, k=10, scale=1024):
    usable = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, qv in {(q, tuple(v)) for q, v in usable if q % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q)[:k]
        out |= {(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scored)}
    return out


def found(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    made = topk.topk(vectors, F.col("vec_id") % 100 == 0)
    return {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in made.collect()}


def vectors(n, seed=1, dims=16):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(700)
    assert found(spark, rows) == truth(rows)


def test_clusters_copies_and_ties(spark):
    rows = vectors(200)
    rows += [(1000 + i, rows[i % 3][1]) for i in range(300)]
    assert found(spark, rows) == truth(rows)


def test_odd_rows(spark):
    rows = vectors(30, dims=4)
    rows += [(100, None), (200, [1.0, None, 0.0, 0.0]), (300, [float("nan")] * 4), (400, [float("inf")] + [0.0] * 3), (500, [0.5, 0.25]), (None, [0.0] * 4), (600, [0.0] * 4), (600, [0.0] * 4)]
    assert found(spark, rows) == truth(rows)
    assert found(spark, vectors(5)[:1]) == set()
    assert found(spark, [(1, [0.5])]) == set()


def test_the_index_stops_on_proof_only():
    rng = np.random.default_rng(4)
    rows = rng.integers(-50, 50, (3000, 8))
    rows[:40] += 200 * np.array([1, -1, 1, 1, -1, 1, 1, 1])
    index = topk.Index(np.arange(3000), rows)
    for q in [*rows[:20], *rng.integers(-5, 5, (20, 8)), np.zeros(8, np.int64)]:
        ids, scores = index.top(q, 7, 10)
        all_ = rows @ q
        want = sorted((-all_[i], i) for i in range(3000) if i != 7)[:10]
        assert [(-s, i) for i, s in zip(ids, scores)] == want
