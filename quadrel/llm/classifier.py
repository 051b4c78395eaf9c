"""Quality classifier: supervised subword embeddings, averaged per document, softmax output.

A word's features are the word itself and the character n-grams of <word>, hashed to `buckets` rows
of a learned table; each pair of neighbouring words adds that pair, hashed likewise, and a pair whose
words are equal one more, the same for all such pairs. A document is the mean of its features' vectors over all words and pairs; a linear layer
and softmax give the label's probability. numpy trains by stochastic gradient descent, in one task, on at most
`sample` labelled rows, those of smallest hash (the bound is a parameter; all rows are scored). As
the layer is linear, a feature's part of the logit is one number: executors get those (a fixed
`buckets` x 4 bytes) and add them up, words seen before from a bounded memory.

Edge cases: null and empty texts have no features and get the bias's probability; without labelled
rows every score is 0.5; a label other than 0 and 1 or null is no label; repeated rows score alike;
a labelled id that documents repeat is learned by one of their texts, so the sample bounds the rows
too; a text of any length is read whole; an empty table gives an empty result; columns other than
those named are ignored, or kept by passing, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import fsum
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import id_field
from .common import give_back, slices

CACHED_CHARS, CACHED_WORDS = 40, 300_000


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 16
    n_min: int = 3
    n_max: int = 4
    sample: int = 4000
    epochs: int = 12
    rate: float = 0.5
    batch: int = 32
    seed: int = 7


def features(word: str, s: Settings) -> np.ndarray:
    """Buckets of the word and of the character n-grams of <word>."""
    marked, hashed = f"<{word}>", xxhash.xxh3_64_intdigest
    grams = {marked[i : i + n] for n in range(s.n_min, s.n_max + 1) for i in range(len(marked) - n + 1)}
    return np.array([hashed("w" + word) % s.buckets, *sorted(hashed(g) % s.buckets for g in grams)], np.int64)


def repeat_bucket(s: Settings) -> int:
    """The feature of a word that its left neighbour equals."""
    return xxhash.xxh3_64_intdigest("p=") % s.buckets


def pair_bucket(pair: tuple[str, str], s: Settings) -> int:
    """The feature of two neighbouring words; no word holds a space."""
    return xxhash.xxh3_64_intdigest("p" + " ".join(pair)) % s.buckets


def document(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct buckets and how often each occurs."""
    counts: dict[str, int] = {}
    words = (text or "").split()
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    parts = [(features(w, s), n) for w, n in counts.items()]
    pairs: dict[tuple[str, str], int] = {}
    for pair in zip(words, words[1:]):
        pairs[pair] = pairs.get(pair, 0) + 1
    parts += [(np.array([pair_bucket(p, s)]), n) for p, n in pairs.items()]
    if again := sum(map(eq, words, words[1:])):
        parts.append((np.array([repeat_bucket(s)]), again))
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    buckets, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return buckets, np.bincount(at, np.repeat([float(n) for _, n in parts], [len(p) for p, _ in parts]))


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, b, n, y: id, buckets, counts and label of the sample; words are hashed on the executors."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("y"))
    chosen = own.orderBy(F.xxhash64("k"), "k").limit(s.sample)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")  # `sample` ids at most
    rows = rows.groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))

    def run(batches):
        for batch in batches:
            for keys, texts, ys in slices(batch, "k", "t", "y"):
                made = [document(t, s) for t in texts]
                yield pa.RecordBatch.from_pydict({"k": pa.array([str(k) for k in keys]), "b": pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary()), "n": pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary()), "y": pa.array(ys, pa.int32())})

    return rows.select("k", "t", F.col("y").cast("int").alias("y")).mapInArrow(run, "k string, b binary, n binary, y int")


def in_order(rows) -> list:
    """(buckets, counts, label) of rows (k, b, n, y) in a fixed order, texts without words left out."""
    return [(np.frombuffer(b, np.int32), np.frombuffer(n, np.float32), y) for _, b, n, y in sorted(rows, key=lambda r: r[:2]) if len(b)]


def examples(docs: DataFrame, labels: DataFrame, label_col: str, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> list:
    """What train() takes, on the driver; fit() learns without that."""
    return in_order(map(tuple, sampled(docs, labels, label_col, s, id_col, text_col).collect()))


def train(rows: list, s: Settings) -> tuple[np.ndarray, float]:
    """(part of the logit of each bucket, bias) after stochastic gradient descent."""
    if not rows or len({y for *_, y in rows}) < 2:
        return np.zeros(s.buckets, np.float32), 0.0
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    layer, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    steps = s.epochs * -(-len(rows) // s.batch)
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), s.batch):
            some = [rows[i] for i in order[at : at + s.batch]]
            rate = s.rate * (1 - step / steps)
            step += 1
            weights = [n / n.sum() for _, n, _ in some]
            mean = np.stack([w @ table[b] for (b, _, _), w in zip(some, weights)])
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), [y for *_, y in some]] -= 1
            back = p @ layer.T
            layer -= rate / len(some) * (mean.T @ p)
            bias -= rate / len(some) * p.sum(0)
            for (b, _, _), w, g in zip(some, weights, back):
                table[b] -= rate * np.outer(w, g)
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class WordParts(dict):
    """Word -> (sum of its features' parts of the logit, how many they are)."""

    def __init__(self, parts: np.ndarray, s: Settings):
        super().__init__()
        self.parts, self.s = parts.tolist(), s
        self.repeat = self.parts[repeat_bucket(s)]

    def __missing__(self, word: str) -> tuple[float, int]:
        """As features() has it, without arrays; fsum gives the same sum in any order of a set."""
        parts, s, hashed = self.parts, self.s, xxhash.xxh3_64_intdigest
        marked, size, buckets = f"<{word}>", len(word) + 2, s.buckets
        grams = {marked[i : i + n] for n in range(s.n_min, s.n_max + 1) for i in range(size - n + 1)}
        entry = (fsum([parts[hashed("w" + word) % buckets], *[parts[hashed(g) % buckets] for g in grams]]), len(grams) + 1)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = entry
        return entry


def probability(text: str | None, known: WordParts, bias: float) -> float:
    words = (text or "").split()
    n = sum(map(eq, words, words[1:]))
    total = n * known.repeat
    for part, k in map(known.__getitem__, words):
        total += part
        n += k
    if len(words) > 1:
        parts, hashed, buckets = known.parts, xxhash.xxh3_64_intdigest, known.s.buckets  # as pair_bucket() has it
        total += sum([parts[hashed(f"p{a} {b}") % buckets] for a, b in zip(words, words[1:])])
        n += len(words) - 1
    logit = bias + (total / n if n else 0.0)
    return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def passing(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5, s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least `least`, with docs' columns."""
    parts, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        known = WordParts(sent.value, s)
        for batch in batches:
            made = [probability(t, known, bias) >= least for (texts,) in slices(batch, text_col) for t in texts]
            yield batch.filter(pa.array(made, pa.bool_()))
        known.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score double."""
    parts, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(parts)  # buckets x 4 bytes, whatever the input

    def run(batches):
        known = WordParts(sent.value, s)
        for batch in batches:
            made = [probability(t, known, bias) for (texts,) in slices(batch, "t") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], [id_col, "score"])
        known.clear()
        give_back()

    return docs.selectExpr(f"`{id_col}` as k", f"`{text_col}` as t").mapInArrow(run, f"`{id_col}` {id_field(docs, id_col)}, score double")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """The model of train(), learned by one task from `sample` rows at most; the driver gets its buckets x 4 bytes alone."""

    def learn(table: pa.Table) -> pa.Table:
        parts, bias = train(in_order(zip(*(table[c].to_pylist() for c in ("k", "b", "n", "y")))), s)
        give_back()
        return pa.table({"parts": pa.array([parts.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    rows = sampled(docs, labels, label_col, s, id_col, text_col)
    made = rows.groupBy().applyInArrow(learn, "parts binary, bias double").collect()
    return (np.frombuffer(made[0]["parts"], np.float32), made[0]["bias"]) if made else train([], s)
