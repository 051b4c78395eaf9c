from __future__ import annotations

import hashlib
import math
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from quadrel.llm import pii, queries

from .cases import edge_docs, edge_texts, empty, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind: str, match: str) -> bool:
    own = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(own) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(own[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(own) <= 15


def base(text: str):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text) if fits(kind, m[0]))


#: The assignment of a secret, its value as a group.
PATTERN = r"""(?<![A-Za-z0-9])(?:pass(?:word|wd)|secret|token|(?:api|access|private|auth)[_-]?key)["']?\s{0,8}[:=]\s{0,8}["']?([A-Za-z0-9+/_.~-]{8,})"""

TRICKY = [
    "a@b.c_d@e.com x@y z@q.r.s.",
    "1.2.3.4.5.6.7.8 01.002.0003.255 1.2.3.256 999.1.1.1.1",
    "4111111111111111 4111 1111-1111 1111 41111111111111112 4 1 1 1",
    "+1 (222) 333-4444+44 20 7946 0958 ++1 2 +123 +1-2-3-4-5-6-7-8-9-0 .",
    "é😀 q@w.de 漢 10.20.30.40 é +49(30)1234567",
    "@" * 500 + "a@" * 500 + "b.c",
    "1." * 3000,
    "+1 " + " " * 3000 + "5",
]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = [*edge_texts(), *TRICKY]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        text = texts[r["doc_id"]] or ""
        assert [(x["start"], x["kind"], x["end"]) for x in r["base"]] == base(text), text[:80]


SECRET = re.compile(PATTERN, re.I)


def protected(text: str):
    """(start, kind, end) and entity of each base span and secret."""
    out = [((a, k, b), f"{k}:" + (text[a:b].lower() if k == 0 else re.sub("[^0-9]", "", text[a:b]))) for a, k, b in base(text)]
    for m in SECRET.finditer(text):
        if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
            out.append(((m.start(), 4, m.end()), f"4:{m[1]}"))
    return out


def terms(text: str):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]


def brute(texts: list[str], s: pii.Settings):
    """All spans of each text, by counting every pair of entity and term."""
    spans = [protected(t) for t in texts]
    free = [[x for x in terms(t) if not any(a < x[1] and b > x[0] for (a, _, b), _ in own)] for t, own in zip(texts, spans)]
    of_entity, of_term, joint = defaultdict(set), defaultdict(set), defaultdict(int)
    for i, (t, own) in enumerate(zip(texts, spans)):
        for _, entity in own:
            of_entity[entity].add(i)
        for *_, term in terms(t):
            of_term[term].add(i)
        for entity in {e for _, e in own}:
            for term in {x[2] for x in free[i]}:
                joint[term, entity] += 1
    n, telling = len(texts), set()
    for (term, entity), both in joint.items():
        told = math.log2(n * both / (len(of_term[term]) * len(of_entity[entity])))
        if both >= s.support and both >= 2**-s.left_bits * len(of_term[term]) and told >= s.told_bits - 1e-12:
            telling.add(term)
    return [sorted([x for x, _ in own] + [(a, 5, b) for a, b, term in some if term in telling]) for own, some in zip(spans, free)], telling


def test_disclosing_terms_equal_brute_force(spark):
    s = pii.Settings()
    texts = [f"{prose(i, 12)} agent zorblatt writes from zor.blatt@mail.example.com about {prose(i + 50, 12)}" for i in range(6)]
    texts += ["zed with one@mail.example.com near"] * 3 + [prose(i, 50) for i in range(100, 160)] + ["an agent of the river", "zorblatt alone", "token = \"0a1b2c3d4e5f\" of quux"]
    texts += ["Quux and api_key: 0a1b2c3d4e5f here", "the secret: understanding", f"hapax once@mail.example.com {prose(7)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, telling = brute(texts, s)
    rows = pii.find(docs, s).collect()
    assert {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["spans"]] for r in rows} == dict(enumerate(want))
    assert {"zorblatt", "zed", "quux"} <= telling and not {"hapax", "river", "the"} & telling
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, pii.find(docs, s)).collect()}
    for i, t in enumerate(texts):
        assert clean[i] == cut_out(t, want[i])
    assert "zorblatt" not in clean[0] and "<email>" in clean[0] and clean[70] == " alone" and "<secret>" in clean[71]


def cut_out(text: str, spans) -> str:
    tags = ["<email>", "<ip>", "<card>", "<phone>", "<secret>", ""]
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], tags[k]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_terms_of_the_tables_equal_brute_force(spark):
    """The query on the small tables: spans of the method, none in documents without any reason."""
    import duckdb

    held = duckdb.execute("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    want, telling = brute([t or "" for _, t in held], pii.Settings())
    name = lambda x: f"{pii.ALL_KINDS[x[1]]}:{x[0]}:{x[2]}"
    rows = {r["doc_id"]: r for r in queries.op6_pii(spark, "/root/testdata/sf0.01").collect()}
    assert {i: ",".join(map(name, own)) for (i, _), own in zip(held, want)} == {i: r["spans"] for i, r in rows.items()}
    for (i, t), own in zip(held, want):
        first = [x for x in own if x[1] < 4]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(map(name, first)).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in first) for j in range(4)]
    assert telling


def test_one_text_of_very_many_matches(spark):
    """Each match costs alike: no text beside a match, nothing that grows with those before."""
    text = " ".join(f"user{i}@host{i % 977}.example.org" for i in range(50_000))
    texts = [text, f"{text} tail", prose(1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = pii.find(docs)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, found).collect()}
    sizes = {r["doc_id"]: len(r["base"]) for r in found.collect()}
    assert sizes == {0: 50_000, 1: 50_000, 2: 0}
    assert clean[0] == " ".join(["<email>"] * 50_000) and clean[2] == texts[2]
    assert time.time() - began < 120


def test_edge_rows(spark):
    docs = edge_docs(spark)
    found = pii.find(docs)
    assert found.count() == docs.count()
    clean = pii.sanitise(docs, found)
    assert clean.columns == docs.columns
    before, after = docs.collect(), clean.collect()
    assert len(after) == len(before)
    assert sum(r["text"] is None for r in after) == 1
    assert not any(base(r["text"]) for r in after if r["text"] and len(r["text"]) < 10_000)
    text = edge_texts()[-1]
    spans = {r["s"] for r in found.select(pii.listed("base").alias("s")).collect()}
    assert len(base(text)) == 6 and ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base(text)) in spans
    assert pii.find(empty(docs)).count() == 0
    assert pii.sanitise(empty(docs), found).count() == 0


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame([(1, "x@y.z")], "doc_id long, text string")
    plan = pii.sanitise(docs, pii.find(docs)).select(F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
