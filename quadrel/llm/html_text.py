"""Main text of a page by minimum-cut labelling of its blocks and containers.

A page is read tag by tag into blocks, runs of text that no block-level tag interrupts, and into the
containers that hold them. Both are nodes of a graph. A linear classifier over a block's text and place
(words, link share, sentence end, letters, kind of tag, whether it lies outside of the page's article elements)
gives its cost of being called content and of being called boilerplate; a container's tag, class, id
and role give its own, for each block in it. These costs are the capacities of the edges to the
terminals. Smoothness edges join a block to its container, a container to the one around it (for each
block in it) and a block to the next, the weaker the further apart they are in the DOM. The maximum
flow's minimum cut labels all nodes at once; the blocks on the source's side are the text. So no word
in a class name decides alone: what is marked as an advert keeps its mark against the text's looks, an
article within a container of a bad name stays content, and a few links or short lines among prose
stay with it, while a run of links doesn't.

A bad mark fades as its container holds more than FADES_FROM of the page's words, unless an article
element lies outside of it: a page wrapped in a form isn't all form.

Containers are known by their parent alone, so a page's cost grows with its length however deep its
tags are nested.

Edge cases: a null or empty page has an empty text; unclosed, misnested and unknown tags are taken as
they come; a page without any block tag is one block; character references are decoded once, after
the markup is read; raw text of scripts, styles and the like is never read as markup, and neither it
nor the text of drawings, form choices and noscript is content; a page of whatever length and depth is
read whole; repeated rows give repeated results; an empty table gives an empty result; columns other
than those named are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import id_field
from .common import FLUSH_BYTES, slices

TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/<>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE, LETTER = re.compile(r"\s+"), re.compile(r"[^\W_]")
#: HTML element sets (fixed values).
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "option", "datalist", "canvas", "audio", "video", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "label"}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "header", "button", "dialog", "fieldset", "label", "head"}
GOOD_TAGS = {"article", "main"}
#: Parts of class and id names that mark what isn't the article, or is.
BAD_NAMES = re.compile(r"(?:^|[-_\s])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|commentlist|respond|replies|reply|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|dialog|footer|foot|header|masthead|menu|navbar|nav|navigation|pagination|pager|promo\w*|related|recommend\w*|share|sharing|social|sidebar|side|aside|widget|sponsor\w*|subscribe|newsletter|signup|login|search|skip|toolbar|topbar|tags|disqus|byline-share|form|copyright|legal|disclaimer|outbrain|taboola)(?:$|[-_\s\d])", re.I)
GOOD_NAMES = re.compile(r"(?:^|[-_\s])(?:article|articlebody|post|entry|story|main|content|body|text)(?:$|[-_\s\d])", re.I)
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Names that say how a page is laid out, as in has-sidebar, not what an element holds.
LAYOUT = re.compile(r"(?:has|no|with|without|is|layout|page|wrapper|container|grid|col|row)[-_]", re.I)
#: Costs of a block; a positive sum speaks for content.
BIAS, WORDS, MOST_WORDS, LINKS, SENTENCE, HEADING, LIST, SYMBOLS, OUTSIDE = -0.4, 0.08, 25, -2.5, 0.5, 0.1, -0.2, -1.0, -1.5
#: Costs of a container for each block in it.
GOOD, BAD, FADES_FROM = 3.0, -3.0, 0.8
#: The page's own, where no article element holds text: what nothing speaks against is its text then.
PLAIN = 0.8
#: Smoothness: block and container, container and the one around it (a block), block and the next one.
WITHIN, UP, NEXT, FADE = 2.6, 1.2, 0.8, 0.5


class Block:
    __slots__ = ("parts", "linked", "home", "tag", "text", "words")

    def __init__(self, home: int, tag: str):
        self.parts: list[str] = []
        self.linked = 0
        self.home, self.tag = home, tag


def mark(tag: str, attributes: str, within: bool) -> int:
    """-1 for a container of what isn't the article, 1 for one of the article, 0 for neither.

    within: whether an article container holds it, whose header is part of the article.
    """
    if tag in BAD_TAGS and not (tag == "header" and within):
        return -1
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "hidden" and tag != "html" or name == "aria-hidden" and value.lower() == "true":
                return -1
            if name == "role":
                if value.lower() in BAD_ROLES:
                    return -1
                if value.lower() in ("main", "article"):
                    return 1
            elif name == "itemprop" and value == "articleBody":
                return 1
            elif name in ("class", "id") and tag not in ("body", "html"):
                names = [x for x in value.split() if not LAYOUT.match(x)]
                if any(map(BAD_NAMES.search, names)):
                    return -1
                if tag not in GOOD_TAGS and any(map(GOOD_NAMES.search, names)):
                    return 1
    return int(tag in GOOD_TAGS)


def blocks_of(page: str) -> tuple[list[Block], list[int], list[int]]:
    """Blocks, and of each container the one around it and its mark; container 0 is the page."""
    found: list[Block] = []
    around, marks, inside = [0], [0], [False]  # inside: within an article container, or one itself
    stack: list[tuple[str, int]] = []  # tag, number of the container
    open_tags: dict[str, int] = {}
    unending: set[str] = set()  # raw tags that no end follows any more
    links, at, n = 0, 0, len(page)
    current: Block | None = None

    def text(piece: str) -> None:
        nonlocal current
        if not piece or current is None and piece.isspace():
            return
        if current is None:
            current = Block(stack[-1][1], stack[-1][0]) if stack else Block(0, "")
            found.append(current)
        piece = entities.unescape(piece)
        current.parts.append(piece)
        if links:
            current.linked += len(piece.split())

    def close(k: int) -> None:
        for tag, _ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                current = None
                if open_tags.get(tag):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    close(k)
        elif tag in RAW:
            if not m[3].rstrip().endswith("/") and tag not in unending:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end is None:
                    unending.add(tag)
                at = end.end() if end else (n if tag in ("script", "style", "textarea", "title") else at)
        elif tag == "br":
            if current is not None:
                current.parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            current = None
            ends = {"p", tag} if tag in ("li", "td", "th", "tr", "dd", "dt") else {"p"}
            if stack and stack[-1][0] in ends:
                close(len(stack) - 1)
            if tag == "hr":
                continue
            links = 0
            above = stack[-1][1] if stack else 0
            own = mark(tag, m[3], inside[above])
            if own or tag not in ("p", "li", "td", "th", "tr", "dd", "dt", "tbody", "h1", "h2", "h3", "h4", "h5", "h6"):
                around.append(above)
                marks.append(own)
                inside.append(own > 0 or inside[above] and own == 0)
                above = len(marks) - 1
            stack.append((tag, above))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    kept = []
    for block in found:
        block.text = SPACE.sub(" ", "".join(block.parts)).strip()
        if block.text:
            block.words = len(block.text.split())
            kept.append(block)
    return kept, around, marks


def leaning(block: Block, outside: bool) -> float:
    """The classifier's value: positive for content."""
    value = BIAS + WORDS * min(block.words, MOST_WORDS) + LINKS * min(1.0, block.linked / block.words)
    value += SENTENCE * (block.text[-1] in ".!?\"'»”")
    if block.tag[:1] == "h" and block.tag[1:].isdigit():
        value += HEADING
    elif block.tag == "li":
        value += LIST
    if not LETTER.search(block.text):
        value += SYMBOLS
    return value + OUTSIDE * outside


def graph_of(blocks: list[Block], around: list[int], marks: list[int]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of the nodes, blocks first and then containers, and the smoothness edges."""
    n, size = len(blocks), len(marks)
    held, words, good = [0] * size, [0] * size, [0] * size  # blocks, words, words of article containers
    for block in blocks:
        held[block.home] += 1
        words[block.home] += block.words
    article = [False] * size
    for c in range(size):  # a container comes after the one around it
        article[c] = marks[c] > 0 or marks[c] == 0 and c > 0 and article[around[c]]
    for block in blocks:
        good[block.home] += block.words * article[block.home]
    for c in range(size - 1, 0, -1):
        for line in (held, words, good):
            line[around[c]] += line[c]
    value = [leaning(b, good[0] > 0 and not article[b.home]) for b in blocks]
    for c in range(size):
        cost = PLAIN * held[0] if c == 0 and not good[0] else 0.0
        if marks[c] > 0:
            cost = GOOD * held[c]
        elif marks[c] < 0:
            share = words[c] / words[0] if words[0] else 0.0
            fade = 1.0 if good[0] > good[c] else min(1.0, (1 - share) / (1 - FADES_FROM))
            cost = BAD * held[c] * fade
        value.append(cost)
    edges = [(i, n + b.home, WITHIN) for i, b in enumerate(blocks)]
    edges += [(n + c, n + around[c], UP * held[c]) for c in range(1, size) if held[c]]
    for i in range(1, n):
        a, b = blocks[i - 1].home, blocks[i].home
        far = 0 if a == b else 1 if around[a] == b or around[b] == a or around[a] == around[b] else 2
        edges.append((i - 1, i, NEXT * FADE**far))
    return value, edges


def minimum_cut(value: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the source keeps: value > 0 is a node's capacity from the source, else to the sink.

    Dinic's algorithm: levels from the source, then blocking flow along them, without recursion.
    """
    n = len(value)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, v in enumerate(value):
        if v > 0:
            join(source, i, v, 0.0)
        elif v < 0:
            join(i, sink, -v, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            mine, moved = out[a], False
            while turn[a] < len(mine):
                e = mine[turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    moved = True
                    break
                turn[a] += 1
            if not moved:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                turn[a] += 1


def main_text(page: str | None) -> str:
    blocks, around, marks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = minimum_cut(*graph_of(blocks, around, marks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text string of each page."""

    def run(batches):
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(2)]
            keys, urls, made, held = [], [], [], 0
            for some, links, pages_ in slices(batch, "k", "u", "h"):
                for key, url, page in zip(some, links, pages_):
                    keys.append(key)
                    urls.append(url)
                    made.append(one := main_text(page))
                    held += len(one)
                if held > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(urls, kinds[1]), pa.array(made, pa.string())], [id_col, url_col, "text"])
                    keys, urls, made, held = [], [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(urls, kinds[1]), pa.array(made, pa.string())], [id_col, url_col, "text"])

    schema = f"`{id_col}` {id_field(pages, id_col)}, `{url_col}` {id_field(pages, url_col)}, text string"
    return pages.selectExpr(f"`{id_col}` as k", f"`{url_col}` as u", f"`{html_col}` as h").mapInArrow(run, schema)
