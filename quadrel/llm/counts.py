"""Token counts of sections: whole documents are encoded once, tokens joined to sections by span.

A section is a line with the line feed that ends it; so n line feeds make n + 1 sections, the last
of which may be empty. Tokens and sections of a document are both ordered by start, so the interval
join is a merge (a binary search of token starts, and ends, among section starts). A token that
crosses a boundary goes whole to one section: rule "first", the one that holds its first character,
or "last", the one that holds its last. So the counts of a document's sections add up to its tokens.

Edge cases: a null text counts as empty; an empty text is one empty section without tokens; the string
of a special token in a text is that token, as in the library; repeated rows give repeated results; a
text of any length is encoded whole; an empty table gives none; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import id_field
from .common import FLUSH_BYTES, slices
from .tokens import piece_tokenizer


def section_starts(text: str) -> np.ndarray:
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def allocate(starts: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary) for tokens of characters [a, b)."""
    first = np.searchsorted(starts, a, "right") - 1
    last = np.searchsorted(starts, np.maximum(b - 1, a), "right") - 1
    return (first if rule == "first" else last), first != last


def count_sections(docs: DataFrame, path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per section: id_col, section, char_start, char_end, n_tokens, n_crossing (its tokens that
    reach into another section), doc_tokens, all long."""
    if rule not in ("first", "last"):
        raise ValueError(f"rule must be first or last, not {rule!r}")
    names = ["section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]
    schema = f"`{id_col}` {id_field(docs, id_col)}, " + ", ".join(f"{n} long" for n in names)

    def run(batches):
        tokens = piece_tokenizer(path, pattern, True)
        for batch in batches:
            kind = batch.schema.field(0).type
            for keys, texts in slices(batch, "k", "t"):
                own, made, held = [], [], 0

                def batch_of(own, made, kind=kind):
                    columns = np.concatenate(made, 1)
                    return pa.RecordBatch.from_arrays([pa.array(own, kind), *map(pa.array, columns)], [id_col, *names])

                for key, text in zip(keys, texts):
                    text = text or ""
                    _, a, b = tokens.ids_and_spans(text)
                    starts = section_starts(text)
                    section, crosses = allocate(starts, a, b, rule)
                    n = len(starts)
                    made.append(np.stack([np.arange(n), starts, np.append(starts[1:], len(text)), np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n), np.full(n, len(a))]).astype(np.int64))
                    own += [key] * n
                    held += 56 * n
                    if held > FLUSH_BYTES:
                        yield batch_of(own, made)
                        own, made, held = [], [], 0
                if own:
                    yield batch_of(own, made)

    return docs.selectExpr(f"`{id_col}` as k", f"`{text_col}` as t").mapInArrow(run, schema)
