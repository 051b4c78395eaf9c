"""Byte-level BPE, encoding by backtracking over longest matches.

Every piece of the text (a match of the split pattern) is encoded on its own. Its bytes are mapped
to Latin-1, an Aho-Corasick automaton of all tokens yields the longest token at each position, and
a left-to-right walk takes the longest one whose end isn't known to be dead and which may stand
next to the token before it. Two tokens may stand side by side if undoing their merges from the
last one on never meets a merge across the border that BPE would have made earlier; that answer is
memoised. A walk that finds no token marks its position as dead and steps back, so each position
is left at most once for each prefix of a token: linear time, and the ids of exact rank merging.

Edge cases: a null text counts as empty and has no ids; empty text has no ids; repeated rows give
repeated results; an empty table gives an empty result; columns other than the two named are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import FLUSH_BYTES, slices
from .split import Splitter

#: Pieces up to this many characters are kept; so many of them at most.
CACHED_CHARS, CACHED_PIECES = 32, 300_000


class Ranks:
    """The tables of one vocabulary: ranks, prefixes, splits and the automaton."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes are no tokens")
        self.length = [len(t) for t in self.bytes_of]
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        self.shorter = [-1] * size
        reached = [True] * size
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1:
                reached[rank] = self._split(token, rank)
        self.memo.clear()
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if reached[rank]:
                self.automaton.add_word(token.decode("latin-1"), rank)
                for k in range(len(token) - 1, 0, -1):
                    found = ranks.get(token[:k], -1)
                    if found >= 0 and reached[found]:
                        self.shorter[rank] = found
                        break
        self.automaton.make_automaton()

    def _split(self, token: bytes, rank: int) -> bool:
        """Find the two tokens whose merge makes this one; False if merging never arrives at it."""
        for k in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if a < rank and b < rank and self._may_follow(a, b):
                self.merged[a, b] = rank
                self.left[rank], self.right[rank] = a, b
                return True
        return False

    def _may_follow(self, a: int, b: int) -> bool:
        merged, left, right = self.merged, self.left, self.right
        limit = len(self.bytes_of)
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:  # a was made last: undo it, or b once a is a single byte
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def follows(self, a: int, b: int) -> bool:
        known = self.memo.get((a, b))
        if known is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[a, b] = self._may_follow(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter = len(piece), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest stays
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0] if n else -1
        while at < n:
            end = at + length[token]
            if not dead[end] and (not out or self.follows(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class PieceIds(dict):
    """Piece -> its ids as packed unsigned 32-bit numbers; bounded, filled by encode_piece."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.encode = ranks.encode_piece

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encode(piece.encode()), np.uint32).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


def _whole(pattern: str, texts: list[str]) -> set[str]:
    """The texts that the library takes as one piece each: it then finds the token of all of the text."""
    own = {text: 256 + k for k, text in enumerate(texts)}
    ranks = {bytes([b]): b for b in range(256)} | {text.encode(): rank for text, rank in own.items()}
    found = set(tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("".join(texts)))
    return {text for text, rank in own.items() if rank in found}


class Codec:
    """Encoder and decoder for one vocabulary file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pieces = Splitter(pattern, lambda texts: _whole(pattern, texts))
        self.packed = PieceIds(self.ranks)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.packed.__getitem__, self.pieces(text or ""))), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def id_field(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.uint32), *arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, ids array<int>, and with decoded the bytes that decoding those ids gives."""
    schema = f"`{id_col}` {id_field(docs, id_col)}, ids array<int>" + ", decoded binary" * decoded

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            kind, keys, ids, back, held = batch.schema.field(0).type, [], [], [], 0
            for some_keys, texts in slices(batch, "k", "t"):
                keys += some_keys
                for text in texts:
                    ids.append(one := own.encode(text))
                    held += one.nbytes
                    if decoded:
                        back.append(plain := own.decode(one))
                        held += len(plain)
                if held > FLUSH_BYTES:
                    yield _batch(keys, kind, ids, back, decoded, id_col)
                    keys, ids, back, held = [], [], [], 0
            if keys:
                yield _batch(keys, kind, ids, back, decoded, id_col)

    return docs.selectExpr(f"`{id_col}` as k", f"`{text_col}` as t").mapInArrow(run, schema)


def _batch(keys, kind, ids, back, decoded, id_col):
    columns = {id_col: pa.array(keys, kind), "ids": _lists(ids)}
    if decoded:
        columns["decoded"] = pa.array(back, pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, decoded binary: the bytes of a table of ids; null ids count as none."""
    schema = f"`{id_col}` {id_field(encoded, id_col)}, decoded binary"

    def run(batches):
        of = load_ranks(path).bytes_of
        for batch in batches:
            kind = batch.schema.field(0).type
            for keys, lists in slices(batch, "k", "i"):
                plain = [b"".join(map(of.__getitem__, ids or ())) for ids in lists]
                yield pa.RecordBatch.from_pydict({id_col: pa.array(keys, kind), "decoded": pa.array(plain, pa.binary())})

    return encoded.selectExpr(f"`{id_col}` as k", f"`{ids_col}` as i").mapInArrow(run, schema)
