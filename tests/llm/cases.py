"""Rows that every operator has to cope with."""

from __future__ import annotations

import random

WORDS = "the of and to in ore river stone light under house green walk seven paper cloud mild grass table".split()


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "s", "ly", "ton", str(rng.randrange(50))])
        out.append(word + (".\n" if i % 13 == 12 else ""))
    return " ".join(out)


def edge_texts() -> list[str | None]:
    long = prose(99, 30_000)
    return [
        None,
        "",
        "   \n\t \x0b\x0c\r ",
        "word",
        "Word",
        "two words",
        "a" * 50_000,
        "9" * 20_000 + "@" + "b" * 20_000,
        "x y " * 3000,
        "line one here\nline one here\n\nline one here\n",
        "<|endoftext|> and é漢字 👩‍👩‍👧 tail next end\x85",
        "### $$$ && || <> ***",
        prose(1),
        prose(1),
        prose(2),
        prose(2) + " one more",
        long,
        long + " end",
        "mail a.b@c-d.example.org or x@y.z, call +1 (222) 333-4444 or +49 30 1234567; 10.0.0.255 10.0.0.256; 4111 1111 1111 1111, 4111-1111-1111-1112",
    ]


def edge_docs(spark, texts=None):
    """documents, with ids repeated, null and large, and columns that operators use themselves."""
    rows = [(i * 7, t) for i, t in enumerate(edge_texts() if texts is None else texts)]
    if texts is None:
        rows += [(35, "two words"), (None, prose(3)), (2**40, prose(4)), (84, prose(1))]
    names = ["k", "t", "id", "ids", "n", "row", "score", "kept", "n_words", "_t", "_h", "sequence_id", "base", "spans", "sig", "term"]
    data = [(i, t, "en", "s", len(t or "")) + ("x",) * len(names) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(data, schema)


def empty(df):
    return df.where("1 = 0")
