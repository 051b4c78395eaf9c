from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quadrel.llm import classifier, quality_rules

from .cases import edge_docs, edge_texts, empty, prose


def base(text: str):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def hashed(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 42)


def features(text: str, buckets: int) -> list[int]:
    tokens = re.findall(r"[^\W]+|[^\w\s]+", text)
    h = [hashed(t) for t in tokens]
    pairs = [a ^ (b << 1) & (1 << 64) - 1 for a, b in zip(h, h[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(x) % buckets for x in [*h, *pairs]]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [t for t in edge_texts() if t is None or t.isascii()]
    texts += [prose(i, 40) for i in range(100, 140)] + [re.sub(r"(\w+)", r"\1***", prose(i, 40)) for i in range(140, 150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = docs.where("doc_id between 20 and 55").select("doc_id")
    return texts, docs, trusted


def test_rules_equal_brute_force(corpus):
    texts, docs, trusted = corpus
    s = quality_rules.Settings(buckets=1 << 10)
    raw, own = np.zeros(s.buckets), np.zeros(s.buckets)
    ids = {r["doc_id"] for r in trusted.collect()}
    for i, t in enumerate(texts):
        for f in features(t or "", s.buckets):
            raw[f] += 1
            own[f] += i in ids
    share = lambda n: np.log(n + s.alpha) - math.log(n.sum() + s.alpha * s.buckets)
    weight = np.rint((share(own) - share(raw)) * quality_rules.SCALE)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, trusted, s).collect()}
    for i, t in enumerate(texts):
        r, f = got[i], features(t or "", s.buckets)
        llr = sum(weight[f]) / (len(f) * quality_rules.SCALE) if f else 0.0
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t or "")
        assert r["llr"] == pytest.approx(llr, abs=1e-12)
        assert r["kept"] == (not r["base_failed"] and llr >= s.threshold)
    ratios = [got[i]["llr"] for i in range(len(texts) - 50, len(texts))]
    assert max(ratios[40:]) < min(ratios[:40])


def test_rules_on_edge_rows(spark):
    docs = edge_docs(spark)
    none = empty(docs).select("doc_id")
    rows = quality_rules.judge(docs, none).collect()
    assert len(rows) == docs.count()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    kept = quality_rules.passing(docs, none)
    assert kept.columns == docs.columns and {r["n_words"] for r in kept.collect()} == {"x"}
    assert quality_rules.judge(empty(docs), none).count() == 0


def test_rules_run_no_python(corpus):
    plan = quality_rules.judge(corpus[1], corpus[2])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_windows_are_those_of_equal_words(spark):
    """Texts of few words, in which windows repeat, touch and overlap."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab" if i % 2 else "abcdef") for _ in range(rng.randint(0, 40))) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge(docs, docs.select("doc_id")).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def test_passing_is_what_judge_keeps(corpus):
    texts, docs, trusted = corpus
    both, s = docs.unionByName(docs.limit(3)), quality_rules.Settings(threshold=-1.15)  # about the middle of these texts
    kept = sorted(r["doc_id"] for r in quality_rules.judge(both, trusted, s).where("kept").collect())
    assert kept == sorted(r["doc_id"] for r in quality_rules.passing(both, trusted, s).collect()) and 10 < len(kept) < 60


def test_an_id_of_many_rows_is_learned_once(spark):
    docs = spark.createDataFrame([(1, prose(i)) for i in range(50)] + [(2, prose(99))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(classifier.examples(docs, labels, "quality", classifier.Settings())) == 2


def test_classifier_learns_and_scores(spark):
    bad = [re.sub(r"(\w+)", r"\1&&", prose(i)) for i in range(150)] + [" ".join(w for w in prose(i, 20).split() for _ in range(9)) for i in range(150)]
    texts = [prose(1000 + i) for i in range(300)] + bad
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600) if i % 3], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    rows = classifier.score(docs, model).collect()
    right = sum((r["score"] >= 0.5) == (r["doc_id"] < 300) for r in rows if r["doc_id"] % 3 == 0)
    assert right >= 195
    assert classifier.fit(docs, labels)[1] == model[1] and (classifier.fit(docs, labels)[0] == model[0]).all()


def test_score_is_the_softmax_of_the_mean_vector():
    s = classifier.Settings(buckets=512, dim=4, epochs=2)
    rows = [(*classifier.document(prose(i, 30), s), i % 2) for i in range(20)]
    parts, bias = classifier.train([(b, n.astype(np.float32), y) for b, n, y in rows], s)
    known = classifier.WordParts(parts, s)
    for i in range(20):
        text = prose(50 + i) + " same same same"
        b, n = classifier.document(text, s)
        logit = bias + float((parts[b].astype(float) * n).sum() / n.sum())
        assert classifier.probability(text, known, bias) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def test_classifier_on_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(7 * i, i % 2) for i in range(15)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    rows = classifier.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = classifier.passing(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] >= 0.5 for r in rows)
    assert classifier.score(empty(docs), model).count() == 0
    untrained = classifier.fit(docs, empty(labels))
    assert {r["score"] for r in classifier.score(docs, untrained).collect()} == {0.5}


def test_fit_hands_the_driver_a_model_alone(spark, monkeypatch):
    """The rows' features stay on the executors; the model equals the one trained on the driver's list."""
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    s = classifier.Settings()
    parts, bias = classifier.train(classifier.examples(docs, labels, "quality", s), s)
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: collected.append(collect(self)) or collected[-1])
    got = classifier.fit(docs, labels)
    assert (got[0] == parts).all() and got[1] == bias
    assert len(collected) == 1 and len(collected[0]) == 1 and len(collected[0][0]["parts"]) == 4 * s.buckets
