from __future__ import annotations

import itertools
import random
import time
import tracemalloc

import duckdb

from quadrel.llm import html_text, queries

from .cases import empty

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li></ul></nav>
<div id="cookie-notice">We use cookies, and by reading on you accept every one of them.</div>
<article><header><h1>Title &amp; more</h1></header><p>A first <b>bold</b> paragraph&nbsp;of
 the article,<br>that says &lt;much&gt;.</p><div class="ad">Buy this fine thing now, today only.</div>
<p>Short.</p><ul><li>one</li><li>two</li></ul><aside><a href=y>Other story</a></aside>
<table><tr><td>cell a<td>cell b</table><!-- <p>hidden</p> --></article>
<section id="comments"><p>A reader wrote this long comment, which has quite a few words in it.</p></section>
<div class="sidebar"><p>Text of a fair length beside the article that nobody asked for.</p></div>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2020 All of it.</footer></body></html>"""
TEXT = "Title & more\nA first bold paragraph of the article, that says <much>.\nShort.\none\ntwo\ncell a\ncell b"


def test_article_without_the_rest():
    assert html_text.main_text(PAGE) == TEXT


def test_page_without_article_element():
    body = " ".join(["Some sentence of the text."] * 12)
    page = f'<body><div class="menu"><a>a</a><a>b</a></div><div><p>{body}</p><p>{body}</p></div><div class="footer">x</div>'
    assert html_text.main_text(page) == f"{body}\n{body}"


def test_odd_pages():
    assert [html_text.main_text(x) for x in (None, "", "   ", "<p></p>", "<", "<!--")][:5] == [""] * 5
    assert html_text.main_text("<article><p>a<p>b</article>") == "a\nb"
    assert html_text.main_text("<article>x &lt;p&gt; y</article>") == "x <p> y"


def test_long_and_hostile_pages_are_read_in_time():
    began = time.time()
    assert len(html_text.main_text("<article>" + "<p>word word.</p><div class=ad>buy</div>" * 20_000 + "</article>").split("\n")) == 20_000
    for page in ("<div>" * 20_000 + "x", "<" * 200_000, "<a " * 60_000, '<a href="' * 30_000, "<p class='" * 30_000, "</p>" * 100_000, "&" * 100_000):
        html_text.main_text(page)
    assert time.time() - began < 60


def energy(value, edges, keep):
    return sum(v for v, k in zip(value, keep) if v > 0 and not k) - sum(v for v, k in zip(value, keep) if v < 0 and k) + sum(w for a, b, w in edges if keep[a] != keep[b])


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 9)
        value = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        best = min(energy(value, edges, keep) for keep in itertools.product((False, True), repeat=n))
        assert abs(energy(value, edges, html_text.minimum_cut(value, edges)) - best) < 1e-6


def test_pages_without_marks_are_kept():
    assert html_text.main_text("<body><p>Short plain page.</p><p>Second line here.</p></body>") == "Short plain page.\nSecond line here."
    assert html_text.main_text("one<p>two<p>three four") == "one\ntwo\nthree four"
    assert html_text.main_text("<form><p>Some plain text in it.</p><p>And more text here too.</p></form>") == "Some plain text in it.\nAnd more text here too."
    assert html_text.main_text("<article>Word</article><nav><a href=x>a</a></nav><footer>(c) me</footer>") == "Word"
    assert html_text.main_text("<nav><a href=x>a</a></nav><footer>(c) me</footer>") == ""


def test_no_name_decides_alone():
    bar = "<div class=sidebar><p>A long enough text beside it, of very many words, that looks like prose in every way.</p></div>"
    assert html_text.main_text(f'<div class="layout has-sidebar"><article><p>Hello.</p></article>{bar}</div>') == "Hello."
    assert html_text.main_text(f'<div class="newsletter"><article><p>Hello there.</p><p>More</p></article></div>{bar}') == "Hello there.\nMore"
    links = "".join(f"<p><a href=x>Link {i}</a></p>" for i in range(8))
    prose = "<p>A sentence of the article that is long enough to be told from others.</p>"
    assert html_text.main_text(f"<article>{prose}<p><a href=x>Only one</a></p>{prose}</article>").count("\n") == 2
    assert html_text.main_text(f"<article>{prose}{links}</article>").count("\n") == 0
    assert html_text.main_text(f"<article>{prose}<p>x <math><mi>y</mi></math> z</p></article>").endswith("x y z")


def plainly(page: str) -> str:
    """The labels by trying all of them on the page's graph."""
    blocks, around, marks = html_text.blocks_of(page)
    value, edges = html_text.graph_of(blocks, around, marks)
    best = min(itertools.product((False, True), repeat=len(value)), key=lambda keep: energy(value, edges, keep))
    return "\n".join(b.text for b, k in zip(blocks, best) if k)


def test_extraction_equals_brute_force():
    """Small random pages: every labelling of blocks and containers is tried."""
    rng = random.Random(3)
    texts = ["Short.", "A sentence of some eight or nine words here.", "word", "<a href=x>link</a>", "a <a href=x>b c</a>", "Long prose " * 12 + "end."]
    opens = ["<div>", "<div class=ad>", "<article>", "<section id=comments>", "<div class=content>", "<nav>", "<ul>", "<h2>"]
    differ = 0
    for _ in range(120):
        page, depth = "", 0
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6:
                page += rng.choice(opens)
                depth += 1
            page += f"<p>{rng.choice(texts)}</p>"
            if depth and rng.random() < 0.5:
                page += rng.choice(["</div>", "</article>", "</section>", "</nav>", "</ul>", "</h2>"])
        assert html_text.main_text(page) == plainly(page), page
        blocks, around, marks = html_text.blocks_of(page)
        value, edges = html_text.graph_of(blocks, around, marks)
        differ += any((v > 0) != k for v, k in zip(value[: len(blocks)], html_text.minimum_cut(value, edges)))
    assert differ > 20  # the cut decides, not the classifier alone


def test_query_over_all_pages(spark):
    rows = queries.op5_html_text(spark, "/root/testdata/sf0.001").collect()
    held = duckdb.execute("SELECT page_id, url, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    want = {(i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in held}
    assert len(rows) == len(held) and {tuple(r) for r in rows} == want


def test_deep_pages_take_time_and_memory_in_proportion():
    for part in ("<div>text", "<div>text</p>", "<option>x", '<div class="ad">text.<div class="post">more.'):
        began = time.time()
        tracemalloc.start()
        html_text.main_text(part * 60_000)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400e6 and time.time() - began < 60, part


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, k string")
    rows = {(r["page_id"], r["url"], r["text"]) for r in html_text.extract(pages).collect()}
    assert rows == {(1, "u", TEXT), (2, None, ""), (None, "v", "")}
    assert html_text.extract(pages).count() == 4 and html_text.extract(empty(pages)).count() == 0
