from __future__ import annotations

import math

import numpy as np
import xxhash

from quadrel.llm import classifier, quality_rules

from .cases import prose


def test_features_and_sample_are_whole():
    assert quality_rules.Settings().buckets == 1 << 16
    s = classifier.Settings()
    assert (s.sample, s.epochs) == (4000, 12)


def test_pairs_of_different_words_are_features():
    s = classifier.Settings(buckets=1 << 20)
    buckets, n = classifier.document("ab cd ab cd cd", s)
    held = dict(zip(buckets.tolist(), n.tolist()))
    of = lambda a, b: held[xxhash.xxh3_64_intdigest(f"p{a} {b}") % s.buckets]
    assert (of("ab", "cd"), of("cd", "ab"), of("cd", "cd")) == (2.0, 1.0, 1.0)
    assert held[classifier.repeat_bucket(s)] == 1.0
    assert n.sum() == sum(len(classifier.features(w, s)) for w in "ab cd ab cd cd".split()) + 4 + 1


def test_order_of_words_counts():
    """The same words in another order: only their pairs tell the labels apart."""
    s = classifier.Settings(buckets=1 << 14, dim=4, epochs=20)
    left = [f"{prose(i, 6)} red blue red blue red blue" for i in range(40)]
    right = [f"{prose(i, 6)} blue red blue red blue red" for i in range(40)]
    rows = [(*classifier.document(t, s), y) for ts, y in ((left, 0), (right, 1)) for t in ts]
    parts, bias = classifier.train([(b, n.astype(np.float32), y) for b, n, y in rows], s)
    known = classifier.WordParts(parts, s)
    for t in left[:5]:
        b, n = classifier.document(t, s)
        want = 1 / (1 + math.exp(-(bias + float((parts[b].astype(float) * n).sum() / n.sum()))))
        assert abs(classifier.probability(t, known, bias) - want) < 1e-9
    assert classifier.probability("blue red", known, bias) > classifier.probability("red blue", known, bias)
