"""Each registered query over whole small tables, against the libraries, its SQL or brute force."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest

from quadrel.llm import queries

from .test_quality import base
from .test_tokens import check_packing, library, tokenizer

SMALL = "/root/testdata/sf0.001"


def table(name: str, columns: str) -> list:
    return duckdb.execute(f"SELECT {columns} FROM '{SMALL}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(table("documents", "doc_id, text"))


def test_op1(spark, texts):
    theirs, rows = library(), queries.op1_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_op2(spark, texts):
    rows = queries.op2_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(texts[r["doc_id"]] or "")
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= -0.2)


def test_op3(spark, texts):
    assert check_packing(queries.op3_packing(spark, SMALL).collect(), texts, 2048) < 0.05


@pytest.mark.parametrize("name", ["op4_topk", "op9_near_duplicates"])
def test_against_sql(spark, name):
    made = queries.QUERIES[name](spark, SMALL)
    held = duckdb.connect()
    for t in ("documents", "embeddings"):
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = held.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(made.columns) == sorted(names)
    assert sorted(tuple(r) for r in made.select(*names).collect()) == sorted(want.fetchall())


def test_op8(spark, texts):
    theirs, rows = tokenizer(), queries.op8_token_counts(spark, SMALL).collect()
    of = {}
    for r in rows:
        of[r["doc_id"]] = of.get(r["doc_id"], 0) + r["n_tokens"]
        assert (texts[r["doc_id"]] or "")[r["char_start"] : r["char_end"]].count("\n") <= 1
    assert of == {k: len(theirs.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}


def test_op10(spark, texts):
    rows = queries.op10_quality_classifier(spark, SMALL).collect()
    labels = dict(table("labels", "doc_id, quality"))
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.85 * len(held)
