from __future__ import annotations

import random

import numpy as np

from quadrel.llm import lm_score

from .cases import edge_docs, empty, prose

S = lm_score.Settings(hidden=16, dim=4, rounds=2, shards=2)


def plain(text: bytes, params, s):
    table, w1, b1, w2, b2 = lm_score.shaped(params, s)
    line = [256] * s.window + list(text) + [256] * s.window
    total = 0.0
    for i in range(s.window, len(line) - s.window):
        x = np.concatenate([table[line[i + k]] for k in [*range(-s.window, 0), *range(1, s.window + 1)]])
        y = np.tanh(x @ w1 + b1) @ w2 + b2
        total += y[line[i]] - np.log(np.exp(y - y.max()).sum()) - y.max()
    return total


def test_counts_cover_every_byte_of_every_document(spark):
    docs = edge_docs(spark)
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    rows = lm_score.count(docs, S).collect()
    assert sum(r["n"] for r in rows) == sum(map(len, texts))
    want = np.unique(lm_score.codes(texts, S.window), return_counts=True)
    assert sorted((r["code"], r["n"]) for r in rows) == list(zip(want[0].tolist(), want[1].tolist()))
    assert lm_score.count(empty(docs), S).count() == 0


def test_shards_grow_with_the_counts(spark):
    s = lm_score.Settings(shards=2, shard_rows=100)
    counted = spark.range(0, 257 * 1000, 257).selectExpr("id as code", "1L as n")
    rows = lm_score.sharded(counted, s).groupBy("shard").count().collect()
    assert sum(r["count"] for r in rows) == 1000 and len(rows) == 10


def test_training_and_scores(spark):
    texts = [prose(i, 40) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    params = lm_score.fit(docs, S)
    assert (lm_score.fit(docs, S) == params).all()
    rng = random.Random(1)
    noise = ["".join(chr(rng.randrange(33, 126)) for _ in range(200)) for _ in range(5)]
    mixed = spark.createDataFrame(list(enumerate([prose(500 + i, 40) for i in range(5)] + noise)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_score.score(mixed, params, S).collect()}
    assert min(rows[i]["mean_logprob"] for i in range(5)) > max(rows[i]["mean_logprob"] for i in range(5, 10)) + 0.5
    for i, text in enumerate(noise):
        assert abs(rows[5 + i]["sum_logprob"] - plain(text.encode(), params, S)) < 1e-2


def test_edge_rows(spark):
    docs = edge_docs(spark)
    params = lm_score.flat(lm_score.initial(S))
    rows = lm_score.score(docs, params, S).collect()
    assert len(rows) == docs.count()
    assert {(r["n_tokens"], r["sum_logprob"]) for r in rows if not r["n_tokens"]} == {(0, 0.0)}
    big = max(rows, key=lambda r: r["n_tokens"])
    assert abs(big["mean_logprob"] * big["n_tokens"] - big["sum_logprob"]) < 1e-6 * abs(big["sum_logprob"])
    assert lm_score.score(empty(docs), params, S).count() == 0
    assert (lm_score.fit(empty(docs), S) == params).all()
