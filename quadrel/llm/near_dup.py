"""MinHash near-duplicates through a multi-index Hamming join of b-bit signatures.

A signature is chunks x width numbers of b bits. If two signatures differ in fewer than
chunks x (errors + 1) places, some chunk of theirs has at most `errors` differences (pigeonhole), so
with one error allowed the chunk's places but one agree: for each chunk every choice of the dropped
place makes a key, and all pairs within that signature distance share a key. At the defaults that
holds for 23 of 72 places and a pair of Jaccard similarity 0.8, which differs in 14.4 on average,
shares no key with a probability of 3e-6.

Equal shingle sets are one class first, so exact copies never meet. Classes that share a key aren't
paired with each other: every key has a hub, the class that shares keys with most others, and
members are checked against their hubs on full sets. Those links give components. Only members of a
key that are in another component than its hub are then compared, on full sets too, with the other
classes of that component's keys, a sorted block of them at once. So no group is expanded into all
its pairs, and a link between different texts is lost only where the two share no key.

Edge cases: words are split at ASCII white space and only A-Z are lower-cased; a text of one word is
one shingle; null, empty and blank texts have none and link with nothing; rows of one id count as
one document that has each of their sets; a null id is kept, alone; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import id_field
from .common import broadcast_if_small, give_back, materialise, short_batches, slices
from .components import components

CACHED_CHARS, CACHED_WORDS = 32, 150_000
M1, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Settings:
    shingle: int = 2
    percent: int = 80
    chunks: int = 12
    width: int = 6
    block: int = 2_000_000
    shares: int = 64
    share_pairs: int = 50_000
    seed: int = 11

    @property
    def places(self) -> int:
        return self.chunks * self.width


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _words() -> WordHashes:
    return WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    known = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    if not n:
        return known
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            mixed = (mixed ^ known[i : len(words) - n + 1 + i]) * M1
            mixed ^= mixed >> np.uint64(29)
        mixed *= M3
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@lru_cache(maxsize=4)
def _hashes(places: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, places, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signature(own: np.ndarray, s: Settings) -> np.ndarray:
    """16 bits of the least value of each hash function."""
    a, b = _hashes(s.places, s.seed)
    least = np.full(s.places, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 2048):
            least = np.minimum(least, (own[at : at + 2048, None] * a + b).min(0))
    return (least & np.uint64(0xFFFF)).astype(np.uint16)


def signed(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_hash, sig; the last two null for an empty set."""

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(0).type
            for keys, texts in slices(batch, "id", "t"):
                n, hashes, sigs = [], [], []
                for text in texts:
                    own = shingles(text, s.shingle)
                    n.append(len(own))
                    hashes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    sigs.append(signature(own, s).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n_shingles", "set_hash", "sig"])
        give_back()

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as t").mapInArrow(run, f"id {id_field(docs, id_col)}, n_shingles long, set_hash binary, sig binary")


def linked(pairs: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough, as a, b. pairs: distinct, a table.

    The pairs of one a, however many, are dealt over `shares` tasks and more; its text goes to each of
    those once, before the texts of its b, not with every pair.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = texts.join(broadcast_if_small(needed, 24), "id", "left_semi")
    shares = max(s.shares, -(-pairs.count() // s.share_pairs))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(shares)).cast("int").alias("share"))
    hubs = dealt.select("a", "share").distinct().join(texts.withColumnRenamed("id", "a"), "a")
    rows = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "share", F.lit(True).alias("member"), "b", "t")
    rows = rows.unionByName(hubs.select("a", "share", F.lit(False).alias("member"), F.col("a").alias("b"), "t"))
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", "member", "b")

    def run(batches):
        key, held = None, {}  # the sets of a: one, unless rows of other texts have its id too
        for batch in batches:
            kind = batch.schema.field(0).type
            for as_, own_shares, members, bs, texts_ in slices(batch, "a", "share", "member", "b", "t"):
                found = []
                for a, share, member, b, text in zip(as_, own_shares, members, bs, texts_):
                    own = shingles(text, s.shingle)
                    if (a, share) != key:
                        key, held = (a, share), {}
                    if not member:
                        held.setdefault(own.tobytes(), own)
                    elif any(similar(x, own, s.percent) for x in held.values()):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], kind) for i in range(2)], ["a", "b"])
        held.clear()
        give_back()

    kind = id_field(docs, id_col)
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity, and anything in common."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def settled(dealt: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) of loose classes to others of their group, one for each component that they touch.

    dealt: family, share, probe, rep, root, loose. A share's block is held as one sorted array of its
    sets; probes come after it, one by one, and their common shingles with all of the block are
    counted at once. Pairs of a component are passed over, and two loose ones meet once.
    """
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("t"))
    texts = texts.join(broadcast_if_small(dealt.select("rep").distinct(), 24), "rep", "left_semi")
    rows = dealt.join(texts, "rep").repartition("family", "share").sortWithinPartitions("family", "share", "probe", "rep")
    names = ["family", "share", "probe", "rep", "root", "loose", "t"]

    def run(batches):
        key, block, index = None, [], None
        for batch in batches:
            out = []
            for columns in slices(batch, *names):
                for family, share, probe, rep, root, loose, text in zip(*columns):
                    if (family, share) != key:
                        key, block, index = (family, share), [], None
                    own = shingles(text, s.shingle)
                    if not probe:
                        block.append((rep, root, loose, own))
                        continue
                    if index is None and block:
                        index = Block(block)
                    if block:
                        out += index.links(rep, root, own, s.percent)
            kind = batch.schema.field(names.index("rep")).type
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], kind) for i in range(2)], ["a", "b"])
        block, index = [], None
        give_back()

    kind = id_field(docs, id_col)
    return rows.select(*names).mapInArrow(run, f"a {kind}, b {kind}")


class Block:
    """The sets of some classes as one sorted array of shingles, each with its class."""

    def __init__(self, rows: list):
        self.reps, self.roots, self.loose, sets = map(list, zip(*rows))
        self.sizes = np.array(list(map(len, sets)), np.int64)
        line = np.concatenate(sets)
        order = np.argsort(line, kind="stable")
        self.line, self.owner = line[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def links(self, rep, root, own: np.ndarray, percent: int) -> list[tuple]:
        low, high = np.searchsorted(self.line, own, "left"), np.searchsorted(self.line, own, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.reps))
        similar = np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(own) - both)))
        found = {}
        for j in similar:
            if self.roots[j] != root and not (self.loose[j] and self.reps[j] >= rep):
                found.setdefault(self.roots[j], (rep, self.reps[j]))
        return list(found.values())


def near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_shingles long, component_id (the smallest id reachable)."""
    with short_batches(docs.sparkSession):
        rows = materialise(signed(docs, s, id_col, text_col), "signatures")
    alive = rows.where("id is not null and set_hash is not null")
    classes = alive.groupBy("set_hash").agg(F.min("id").alias("rep"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"))
    keyed = _slotted(classes, s)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(shared, "key"), "members")  # rep, slot, key, n
    central = members.groupBy("rep").agg(F.sum("n").alias("meets"))
    ranked = members.join(central, "rep")
    hubs = ranked.groupBy("key").agg(F.min(F.struct((-F.col("meets")).alias("m"), F.col("rep").alias("hub"))).alias("h")).select("key", F.col("h.hub").alias("hub"))
    members = materialise(members.join(hubs, "key"), "members")
    stars = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    with short_batches(docs.sparkSession):
        links = materialise(linked(materialise(stars, "pairs"), docs, s, id_col, text_col), "links")
    same = alive.groupBy("id").agg(F.countDistinct("set_hash").alias("n")).where("n > 1")  # ids of several sets
    own = alive.join(same.select("id"), "id", "left_semi").join(classes.select("set_hash", "rep"), "set_hash").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(own)
    roots = components(links)
    dealt = materialise(_unsettled(members, roots, classes, s), "families")
    with short_batches(docs.sparkSession):
        more = materialise(settled(dealt, docs, s, id_col, text_col), "links")
    # links between components are few: the components of these alone, then both steps from a class
    first = roots.select(F.col("node").alias("rep"), "root")
    of = lambda c: more.join(first, more[c] == F.col("rep"), "left").select(F.coalesce("root", more[c]).alias(f"{c}_root"), "a", "b")
    between = of("a").join(of("b").select("a", "b", "b_root"), ["a", "b"])
    second = components(between.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    second = second.select(F.col("node").alias("root"), F.col("root").alias("further"))
    return (
        rows.join(classes.select("set_hash", "rep"), "set_hash", "left")
        .join(first, "rep", "left")
        .withColumn("root", F.coalesce("root", "rep", "id"))
        .join(second, "root", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("further", "root")).alias("component_id"))
    )


def _slotted(classes: DataFrame, s: Settings) -> DataFrame:
    """rep, slot, key: the keys of each class; a slot is a chunk and the place dropped from it."""
    bytes_of = lambda first, n: F.substring("sig", 2 * first + 1, 2 * n)
    made = []
    for c in range(s.chunks):
        for d in range(s.width):
            k = c * s.width + d
            made.append(F.xxhash64(F.lit(k), bytes_of(c * s.width, d), bytes_of(k + 1, s.width - d - 1)))
    return classes.select("rep", F.posexplode(F.array(*made)).alias("slot", "key"))


def _unsettled(members: DataFrame, roots: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """family, share, probe, rep, root, loose: who is to be compared with whom beside the hubs.

    A key's family is its hub's component. A member in another component is loose there; the family's
    classes are all members of its keys that have a loose one, each once. They are dealt over shares
    of about `block` shingles, and loose ones are sent to every share as probes.
    """
    root = roots.select(F.col("node").alias("rep"), "root")
    placed = members.where("n > 2").join(root, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    of_hub = placed.where("rep = hub").select("key", F.col("root").alias("family"))
    placed = placed.join(of_hub, "key").withColumn("loose", F.col("root") != F.col("family"))
    open_keys = placed.groupBy("key").agg(F.max("loose").alias("any")).where("any").select("key")
    held = placed.join(open_keys, "key", "left_semi").select("family", "rep", "root", "loose").distinct()
    held = held.join(classes.select("rep", "n_shingles"), "rep")
    shares = held.groupBy("family").agg(F.ceil(F.sum("n_shingles") / s.block).cast("int").alias("shares"))
    held = materialise(held.join(shares, "family"), "families")
    blocks = held.withColumn("share", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int")).withColumn("probe", F.lit(False))
    probes = held.where("loose").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("probe", F.lit(True))
    return blocks.unionByName(probes).select("family", "share", "probe", "rep", "root", "loose")


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the documents that have a smaller id in their component, and with one of several
    rows that agree in all columns; null ids stay."""
    gone = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    again = found.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNotNull() & (F.col("n") > 1)).select(id_col)
    left = docs.join(broadcast_if_small(gone, 16), id_col, "left_anti")
    again = broadcast_if_small(again, 16)
    return left.join(again, id_col, "left_anti").unionByName(left.join(again, id_col, "left_semi").distinct())
