from __future__ import annotations

import random

import numpy as np

from quadrel.llm import near_dup
from quadrel.llm.components import components

from .cases import edge_docs, edge_texts, empty, prose


def truth(rows, k: int = 2):
    sets, parent = {}, {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        own = frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()
        sets.setdefault(key, []).append(own)
        parent[key] = key

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}, sets


def found(docs):
    return {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dup.near_duplicates(docs).collect()}


def against_truth(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, sets = truth(rows)
    got = found(docs)
    assert got == {(k, len(sets[k][0])): root for k, root in want.items()}


def edited(text: str, share: float, seed: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    return " ".join(f"w{rng.random()}" if rng.random() < share else w for w in words)


def test_components_equal_brute_force(spark):
    texts = [prose(i, 80) for i in range(60)]
    for i in range(60):
        texts += [edited(texts[i], share, 7 * i) for share in (0.02, 0.06, 0.1)]
    against_truth(spark, texts)


def test_a_large_group_of_copies_and_one_of_near_copies(spark):
    hub = prose(5, 150)
    texts = [hub] * 200 + [edited(hub, 0.15 * random.Random(i).random(), i) for i in range(250)] + [prose(1000 + i, 100) for i in range(50)]
    against_truth(spark, texts)


def test_a_chain_of_copies_of_copies(spark):
    texts = [prose(9, 200)]
    for i in range(40):
        texts.append(edited(texts[-1], 0.04, i))
    random.Random(1).shuffle(texts)
    against_truth(spark, texts)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    want, _ = truth(rows)
    made = near_dup.near_duplicates(docs).collect()
    assert len(made) == docs.count()
    assert {r["doc_id"]: r["component_id"] for r in made if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in made if r["doc_id"] is None] == [None]
    kept = near_dup.kept_rows(docs, near_dup.near_duplicates(docs))
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert sorted(set(left) - {None}) == sorted(set(want.values())) and None in left
    assert left.count(35) == 1  # a row that is there twice
    assert near_dup.near_duplicates(empty(docs)).count() == 0


def test_pigeonhole_covers_all_pairs_within_its_distance(spark):
    """By the keys that the operator makes: some key of both is the same."""
    s = near_dup.Settings()
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        a = rng.integers(0, 1 << 16, s.places, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(s.places, 2 * s.chunks - 1, replace=False)] ^= 1
        rows += [(2 * i, a.tobytes()), (2 * i + 1, b.tobytes())]
    made = near_dup._slotted(spark.createDataFrame(rows, "rep long, sig binary"), s).collect()
    keys = {}
    for r in made:
        keys.setdefault(r["rep"], set()).add((r["slot"], r["key"]))
    assert all(len(k) == s.places for k in keys.values())
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(200))


def test_a_hub_is_met_in_shares(spark):
    """The links of one text with very many others, in more shares than tasks, equal its plain comparison."""
    hub = prose(5, 150)
    texts = [hub] + [edited(hub, 0.2 * random.Random(i).random(), i) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 301)], "a long, b long")
    sets = truth(list(enumerate(texts)))[1]
    want = {(0, i) for i in range(1, 301) if 100 * len(sets[0][0] & sets[i][0]) >= 80 * len(sets[0][0] | sets[i][0])}
    for s in (near_dup.Settings(), near_dup.Settings(share_pairs=2)):
        assert {tuple(r) for r in near_dup.linked(pairs, docs, s, "doc_id", "text").collect()} == want
    assert 50 < len(want) < 290


def test_shingles_are_ascii_lower_and_split_at_ascii_space():
    assert (near_dup.shingles("A B\x0bC", 2) == near_dup.shingles("a b c", 2)).all()
    assert len(near_dup.shingles("É é x", 2)) == 1
    assert len(near_dup.shingles(" ", 2)) == 0 and len(near_dup.shingles("One", 2)) == 1
    assert len(near_dup.shingles(edge_texts()[8], 2)) == 2


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 300)] + [(900, 900)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and all(got[500 + i] == 500 for i in range(1, 300)) and 900 not in got


def test_links_between_families_are_found(spark):
    """Two groups that only loose members join: the components of the groups are joined too."""
    left, right = prose(21, 200).split(" "), prose(22, 200).split(" ")
    bridge = [" ".join(left[: 200 - 10 * i] + right[200 - 10 * i :]) for i in range(21)]
    texts = [edited(" ".join(left), 0.02, i) for i in range(30)] + [edited(" ".join(right), 0.02, 50 + i) for i in range(30)] + bridge
    against_truth(spark, texts)
