"""Splitting a text into the pieces that a tokenizer library would merge on their own.

The libraries carry Unicode tables of other versions than the regex module does. The few code
points on which those tables disagree are put to the library itself, once for each process, and
texts that hold one of them are split by a pattern corrected for them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex


@lru_cache(maxsize=1)
def disputed() -> tuple[list[str], list[str]]:
    """Code points that regex and this Python's own tables don't agree to be letters, numbers."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    category = list(map(unicodedata.category, points))
    found = []
    for kind in "LN":
        has = set(regex.findall(rf"\p{{{kind}}}", "".join(points)))
        found.append([c for c, k in zip(points, category) if (c in has) != (k[0] == kind)])
    return found[0], found[1]


def narrowed(pattern: str) -> str:
    """The pattern for texts of the first 256 code points alone, its classes spelt out for re."""
    points = [chr(i) for i in range(256)]
    named = {k: "".join(re.escape(c) for c in points if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    inner = "".join(named[k] for k in (r"\s", r"\p{L}", r"\p{N}"))
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{inner}]").replace(r"\S", f"[^{named[r'\s']}]")
    for k, held in named.items():
        pattern = pattern.replace(k, f"[{held}]")
    return pattern


class Splitter:
    """pieces(text) -> matches of pattern as a library with the given splitting finds them.

    whole: which of the given texts are one piece each, according to that library.
    """

    def __init__(self, pattern: str, whole: Callable[[list[str]], set[str]]):
        letters, numbers = disputed()
        as_letter = {text[2] for text in whole([f" x{c}y" for c in letters])}
        as_number = {text[2] for text in whole([f" 1{c}1" for c in numbers])}
        sets = {}
        for kind, points, held in (("L", letters, as_letter), ("N", numbers, as_number)):
            no = "".join(c for c in points if c not in held)
            yes = "".join(held)
            own = f"[\\p{{{kind}}}--[{no}]]" if no else f"\\p{{{kind}}}"
            sets[kind] = f"[{own}||[{yes}]]" if yes else own
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{sets['L']}{sets['N']}]")
        for kind in "LN":
            exact = exact.replace(rf" ?\p{{{kind}}}+", f" ?{sets[kind]}+")
        self.plain = regex.compile(pattern).findall
        self.narrow = re.compile(narrowed(pattern)).findall
        self.exact = regex.compile(exact, regex.V1).findall
        self.odd = regex.compile(f"[{''.join(letters + numbers)}]").search

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # holds no disputed code point, and is told fast
        except UnicodeEncodeError:
            return self.exact(text) if self.odd(text) else self.plain(text)
        return self.narrow(text)
