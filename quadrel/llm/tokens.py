"""A tokenizer file of the tokenizers library, applied piece by piece with a bounded memory of pieces.

As in the library by default, the string of a special token in a text is that token, and what lies
before and after it is split on its own.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .split import Splitter

#: Pieces up to this many characters are kept; so many of them at most.
CACHED_CHARS, CACHED_PIECES = 32, 250_000


class PieceTokens(dict):
    """Piece -> packed 32-bit ids."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path} has added tokens that take in what is around them")
        self.added = {t.content: i for i, t in added.items()}
        self.model = self.tokenizer.model
        if self.tokenizer.normalizer is not None or type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{path} is no byte-level tokenizer without a normalizer")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level tokenizers show these as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}

    def sizes(self) -> np.ndarray:
        """Bytes of the token of each id; the model shows a byte as one character."""
        size = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        if missing := [b for b, c in self.shown.items() if self.model.token_to_id(chr(c)) is None]:
            raise ValueError(f"{len(missing)} single bytes are no tokens")
        size |= {i: len(t.encode()) for t, i in self.added.items()}
        made = np.zeros(max(size) + 1, np.int64)
        made[list(size)] = list(size.values())
        return made

    def whole(self, texts: list[str]) -> set[str]:
        """The texts that the tokenizer's own splitting takes as one piece each."""
        text = "".join(texts)
        return {text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)} & set(texts)

    def __missing__(self, piece: str):
        """The model merges the piece's bytes; splitting is done, and nothing else is left to do."""
        if piece in self.added:
            return np.array([self.added[piece]], np.uint32).tobytes()
        made = self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))
        packed = np.array([t.id for t in made], np.uint32).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class PieceTokenizer:
    """Ids, and spans if asked for, of whole texts."""

    def __init__(self, path: str, pattern: str, spans: bool = False):
        self.known = PieceTokens(path)
        self.sizes = self.known.sizes() if spans else None
        self.split = Splitter(pattern, self.known.whole)
        named = sorted(self.known.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, named)) + ")").split if named else None
        self.first = os.path.commonprefix(named)

    def pieces(self, text: str) -> list[str]:
        if self.special is None or self.first not in text:
            return self.split(text)
        parts = self.special(text)  # an added token at each odd place
        return [x for i, part in enumerate(parts) for x in ((part,) if i % 2 else self.split(part))]

    def ids(self, text: str | None) -> bytes:
        """Packed unsigned 32-bit ids."""
        return b"".join(map(self.known.__getitem__, self.pieces(text or "")))

    def ids_and_spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the characters [start, end) that hold each token's bytes."""
        text = text or ""
        ids = np.frombuffer(self.ids(text), np.uint32)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)  # in bytes: tokens lie side by side
        starts = ends - sizes
        if not text.isascii():
            char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80, dtype=np.int32) - 1
            starts, ends = char[starts], char[ends - 1] + 1
        return ids, starts, ends


@lru_cache(maxsize=4)
def piece_tokenizer(path: str, pattern: str, spans: bool = False) -> PieceTokenizer:
    return PieceTokenizer(path, pattern, spans)
