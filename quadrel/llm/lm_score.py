"""Masked pseudo-likelihood of documents by a bidirectional window network.

A token is a byte of the text's UTF-8. The network predicts each from the `window` bytes on either
side (embeddings, one tanh layer, softmax over 256); a document's score is the sum of the logarithms
of those probabilities, also given by token.

The objective depends on the corpus only by how often each byte occurs in each context, so these
counts are gathered from all documents, reduced on the map side, and are the training set: all of it,
whatever its size. They are dealt in shards by hash of the context, `shards` and more as the counts grow, so that
a shard has about `shard_rows` of them. In each round every shard trains
a copy of the network by stochastic gradient descent on its counts, and the copies' steps are
averaged by the bytes they stand for. Steps are summed as whole numbers per parameter by Spark, so
the driver gets one number for each parameter and the result doesn't hang on the order of arrival.

Edge cases: null and empty texts have no tokens and score 0, also by token; without any token the
network stays as it began; positions beyond a text's ends are a symbol of their own; long texts are
read whole, in parts; repeated rows score alike; an empty table gives an empty result; columns other
than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import id_field
from .common import materialise, slices

EDGE, BASE, STEP_UNIT = 256, 257, 1 << 24
#: Bytes of text whose positions are looked up at once; slots of a worker's memory of scored positions.
CHUNK, SLOTS = 1 << 20, 1 << 22


@dataclass(frozen=True)
class Settings:
    window: int = 2
    dim: int = 8
    hidden: int = 48
    rounds: int = 4
    passes: int = 2
    batch: int = 256
    rate: float = 0.02
    shards: int = 12
    shard_rows: int = 500_000
    seed: int = 5


def initial(s: Settings) -> list[np.ndarray]:
    rng = np.random.default_rng(s.seed)
    wide = 2 * s.window * s.dim
    return [
        rng.normal(0, 0.3, (BASE, s.dim)),
        rng.normal(0, wide**-0.5, (wide, s.hidden)),
        np.zeros(s.hidden),
        rng.normal(0, 0.1, (s.hidden, 256)),
        np.zeros(256),
    ]


def flat(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def shaped(values: np.ndarray, s: Settings) -> list[np.ndarray]:
    out, at = [], 0
    for p in initial(s):
        out.append(values[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


def codes(texts: list[bytes], window: int) -> np.ndarray:
    """For each byte of each text its context and itself as one number: context * BASE + byte."""
    pad = np.full(window, EDGE, np.int64)
    parts = [pad]
    for text in texts:
        parts += [np.frombuffer(text, np.uint8).astype(np.int64), pad]
    line = np.concatenate(parts)
    at = np.flatnonzero(line != EDGE)
    made = np.zeros(len(at), np.int64)
    for k in [*range(-window, 0), *range(1, window + 1), 0]:
        made = made * BASE + line[at + k]
    return made


def context_symbols(contexts: np.ndarray, s: Settings) -> np.ndarray:
    out = np.empty((len(contexts), 2 * s.window), np.int64)
    for k in range(2 * s.window - 1, -1, -1):
        contexts, out[:, k] = np.divmod(contexts, BASE)
    return out


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def log_probability(numbers: np.ndarray, params: list[np.ndarray], s: Settings) -> np.ndarray:
    """Of the byte in its context, for each number."""
    table, w1, b1, w2, b2 = params
    out = np.empty(len(numbers), np.float64)
    for at in range(0, len(numbers), 8192):
        contexts, targets = np.divmod(numbers[at : at + 8192], BASE)
        own, where = np.unique(contexts, return_inverse=True)
        x = table[context_symbols(own, s)].reshape(len(own), -1)
        out[at : at + 8192] = log_softmax(np.tanh(x @ w1 + b1) @ w2 + b2)[where, targets]
    return out


def train_shard(numbers: np.ndarray, counts: np.ndarray, params: list[np.ndarray], s: Settings, turn: int) -> list[np.ndarray]:
    """Some passes of Adam over the counted positions, in orders drawn from the seed."""
    params = [p.astype(np.float64).copy() for p in params]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    draw = np.random.default_rng((s.seed, turn))
    order = np.concatenate([draw.permutation(len(numbers)) for _ in range(s.passes)])
    rate = s.rate / (1 + turn)
    for at in range(0, len(order), s.batch):
        pick = order[at : at + s.batch]
        contexts, targets = np.divmod(numbers[pick], BASE)
        weight = counts[pick] / counts[pick].sum()
        table, w1, b1, w2, b2 = params
        symbols = context_symbols(contexts, s)
        x = table[symbols].reshape(len(pick), -1)
        h = np.tanh(x @ w1 + b1)
        p = np.exp(log_softmax(h @ w2 + b2))
        p[np.arange(len(pick)), targets] -= 1
        p *= weight[:, None]
        back = (p @ w2.T) * (1 - h * h)
        of_table = np.zeros_like(table)
        np.add.at(of_table, symbols.ravel(), (back @ w1.T).reshape(-1, s.dim))
        step += 1
        for k, g in enumerate((of_table, x.T @ back, back.sum(0), h.T @ p, p.sum(0))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return params


def chunks(batch, *columns: str):
    """Rows of about CHUNK bytes of text: lists of the columns' values, the last as bytes."""
    held: list[list] = [[] for _ in columns]
    size = 0
    for part in slices(batch, *columns):
        for row in zip(*part):
            for own, value in zip(held, row):
                own.append(value)
            held[-1][-1] = (row[-1] or "").encode()
            size += len(held[-1][-1])
            if size >= CHUNK:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def count(docs: DataFrame, s: Settings, text_col: str = "text") -> DataFrame:
    """code, n: how often each byte occurs in each context, over all documents."""

    def run(batches):
        numbers, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for (texts,) in chunks(batch, "t"):
                new, many = np.unique(codes(texts, s.window), return_counts=True)
                both, where = np.unique(np.concatenate([numbers, new]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n, many]), len(both)).astype(np.int64)
                numbers = both
                if len(numbers) > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(n)], ["code", "n"])
                    numbers, n = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(numbers):
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(n)], ["code", "n"])

    return docs.selectExpr(f"`{text_col}` as t").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def sharded(counted: DataFrame, s: Settings) -> DataFrame:
    """counted, a table, with the shard of each context."""
    shards = max(s.shards, -(-counted.count() // s.shard_rows))
    return counted.withColumn("shard", F.pmod(F.xxhash64(F.expr(f"code div {BASE}")), F.lit(shards)).cast("int"))


def shard_step(sent, s: Settings, turn: int):
    """A shard's step from the parameters sent, in units of 1 / STEP_UNIT, with its bytes as mass."""

    def step(group: pa.Table) -> pa.Table:
        order = np.argsort(group["code"].to_numpy(), kind="stable")
        numbers, n = group["code"].to_numpy()[order], group["n"].to_numpy()[order].astype(np.float64)
        moved = flat(train_shard(numbers, n, shaped(sent.value, s), s, turn)) - sent.value
        units = np.rint(moved * STEP_UNIT).astype(np.int64)
        return pa.table({"mass": [n.sum()], "delta": pa.array([units.tolist()], pa.list_(pa.int64()))})

    return step


def fit(docs: DataFrame, s: Settings = Settings(), text_col: str = "text") -> np.ndarray:
    """The network's parameters, as one line of numbers."""
    table = sharded(materialise(count(docs, s, text_col), "contexts"), s)
    spark = docs.sparkSession
    params = flat(initial(s))
    for turn in range(s.rounds):
        sent = spark.sparkContext.broadcast(params)  # some 16 thousand numbers

        moves = materialise(table.groupBy("shard").applyInArrow(shard_step(sent, s, turn), "mass double, delta array<long>"), "steps")
        total = moves.agg(F.sum("mass").alias("m")).first()["m"] or 0.0
        summed = moves.select("mass", F.posexplode("delta").alias("at", "d")).groupBy("at").agg(F.sum((F.col("d") * F.col("mass") / F.lit(total or 1.0)).cast("long")).alias("d")).collect()
        for r in summed:
            params[r["at"]] += r["d"] / STEP_UNIT
        sent.unpersist()
    return params


def score(docs: DataFrame, params: np.ndarray, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_tokens long, sum_logprob and mean_logprob double."""
    sent = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        own = [p.astype(np.float32) for p in shaped(sent.value, s)]
        slot_code, slot_value = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.float64)

        def of(numbers: np.ndarray) -> np.ndarray:
            slot = ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 22)).astype(np.int64)
            values = slot_value[slot]
            missed = np.flatnonzero(slot_code[slot] != numbers)
            if len(missed):
                new, where = np.unique(numbers[missed], return_inverse=True)
                made = log_probability(new, own, s)
                values[missed] = made[where]
                slot_code[slot[missed]] = numbers[missed]
                slot_value[slot[missed]] = values[missed]
            return values

        for batch in batches:
            kind = batch.schema.field(0).type
            for keys, texts in chunks(batch, "k", "t"):
                sizes = np.array([len(t) for t in texts], np.int64)
                numbers = codes(texts, s.window)
                values = np.concatenate([np.empty(0), *[of(numbers[at : at + CHUNK]) for at in range(0, len(numbers), CHUNK)]])
                ends = np.cumsum(sizes)
                sums = np.array([values[e - n : e].sum() for e, n in zip(ends, sizes)])
                mean = np.where(sizes > 0, sums / np.maximum(sizes, 1), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sizes), pa.array(sums, pa.float64()), pa.array(mean, pa.float64())], [id_col, "n_tokens", "sum_logprob", "mean_logprob"])

    schema = f"`{id_col}` {id_field(docs, id_col)}, n_tokens long, sum_logprob double, mean_logprob double"
    return docs.selectExpr(f"`{id_col}` as k", f"`{text_col}` as t").mapInArrow(run, schema)
