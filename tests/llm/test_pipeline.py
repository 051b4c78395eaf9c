from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from quadrel.llm import pii
from quadrel.llm.common import materialise, table
from quadrel.llm.queries import ORACLES, QUERIES, TOKENIZER

from .cases import edge_docs
from .test_near_dup import truth
from .test_pii import base, brute, cut_out
from .test_quality import base as counted
from .test_tokens import tokenizer

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialise(stage(spark, docs, SMALL), name)
    return [*out, docs]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stage_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "pii", "packing"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_rules_and_classifier_keep_the_good(spark, steps):
    labels = rows(table(spark, SMALL, "labels"))
    given, passed, scored = map(rows, steps[:3])
    assert not any(counted(r["text"] or "")[-1] for r in passed.values())
    good = [i for i in given if i in labels and labels[i]["quality"] == 1 and not counted(given[i]["text"] or "")[-1]]
    assert sum(i in scored for i in good) >= 0.98 * len(good)
    bad = [i for i in given if i in labels and labels[i]["quality"] == 0]
    assert sum(i in scored for i in bad) <= 0.1 * len(bad)


def test_one_document_of_each_group_stays(steps):
    given, left = rows(steps[2]), rows(steps[3])
    roots, _ = truth([(k, r["text"]) for k, r in given.items()], 5)
    assert set(left) == set(roots.values())
    assert all(left[k] == given[k] for k in left)


def test_personal_data_is_gone(steps):
    given, left = rows(steps[3]), rows(steps[4])
    assert set(left) == set(given)
    keys = sorted(given)
    spans, _ = brute([given[k]["text"] or "" for k in keys], pii.Settings())
    for k, own in zip(keys, spans):
        assert left[k]["text"] == cut_out(given[k]["text"], own)
        assert not base(left[k]["text"]) and left[k]["n_chars"] == len(left[k]["text"])


def test_pieces_cover_the_texts(steps):
    left, theirs, held = rows(steps[4]), tokenizer(), {}
    for r in steps[5].collect():
        held.setdefault(r["doc_id"], []).append(r)
    assert set(held) == set(left)
    for k, parts in held.items():
        ids = np.array([*theirs.encode(left[k]["text"], add_special_tokens=False).ids, 1], "<u4")
        assert sum(r["length"] for r in parts) == len(ids) == parts[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)


def test_stages_on_edge_rows(spark):
    docs = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        made.write.format("noop").mode("overwrite").save()
        none = stage(spark, docs.where("1 = 0"), SMALL)
        assert none.columns == made.columns and none.count() == 0


def test_queries_are_named_by_number():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES) and TOKENIZER.endswith(".json")
