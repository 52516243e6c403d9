import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import wrapper_induction as X


def article(page):
    """The article of the generated pages, by their own plain layout."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(t for t in (re.sub(r"\s+", " ", p).strip() for p in parts) if t)


def test_whole_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in X.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


PAGE = """<html><head><title>t</title><style>x</style></head><body><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
<div><p>Welcome to our site</p></div><div><h2>Title {i}</h2><p>Body &amp; text   number {i}<br>goes on</p><ul><li>one {i}<li>two {i}</ul></div>
<div class="comments"><p>Nice {i}!</p></div><form><p>Name</p></form><aside>side {i}</aside><p>All rights reserved</p><script>var a = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_template_is_induced(spark, monkeypatch, limit):
    monkeypatch.setattr(X, "BROADCAST_BYTES", limit)
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i), "x") for i in range(8)] + [(9, None, None, "x"), (10, "nonsense", "", "x"), (11, "http://one.example", PAGE.format(i=3), "x"), (None, "http://two.example", "plain < text & more", "x")]
    docs = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string")
    got = X.extract(docs).collect()
    assert len(got) == len(rows) + 1
    by = {r.page_id: r.text for r in got}
    for i in range(8):
        assert by[i] == f"Title {i}\nBody & text number {i} goes on\none {i}\ntwo {i}"
    assert by[9] == "" and by[10] == "" and by[None] == "plain < text & more"
    assert "Welcome" in by[11]  # one page has no template


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [b["text"] for b in X.page_blocks(deep, deep)] == ["x"]
    long = "<body>" + "".join(f"<p>p{i}</p>" for i in range(3000)) + "</body>"
    assert len(X.page_blocks(long, long)) == 3000


def test_long_lists_and_deep_trees_keep_their_slots():
    def page(n, deep):
        items = "".join(f"<p>c {i}</p>" if i % 3 else f"<div><b>t {i}</b></div>" for i in range(n))
        return f"<body>{items}<h2>heading</h2>{'<div>' * deep}<i>x</i>{'</div>' * deep}</body>"

    for n, m, deep, less in ((900, 880, 0, 0), (1100, 1080, 0, 0), (2500, 2400, 0, 0), (9, 12, 3000, 2990)):
        slot = {b["text"]: b["slot"] for b in X.page_blocks(page(m, less), "")}["heading"]
        assert {b["text"]: b["slot"] for b in X.page_blocks(page(n, deep), page(m, less))}["heading"] == slot != -1


def test_halved_alignments_gain_as_much(monkeypatch):
    rng = np.random.default_rng(4)
    gains = rng.integers(0, 4, (9, 9)) + 5 * np.eye(9, dtype=int)
    for _ in range(60):
        a, b = (rng.integers(0, 9, rng.integers(0, 40)).tolist() for _ in range(2))
        found = []
        for cells in (1 << 20, 1):
            monkeypatch.setattr(X, "_TABLE_CELLS", cells)
            pairs = X.align(a, b, lambda x, y: int(gains[x, x] + 9 if x == y else gains[x, y]))
            assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
            found.append(sum(int(gains[a[i], a[i]] + 9 if a[i] == b[j] else gains[a[i], b[j]]) for i, j in pairs))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                g = gains[x, x] + 9 if x == y else gains[x, y]
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + g)
        assert found[0] == found[1] == table[-1, -1]


PLAIN = """<body><div class="k1"><a href="/{i}">Start</a> <a href="/b">Shop</a></div><div class="k2">Autumn sale: all at half the price!</div>
<div class="k3"><h2>Heading {i}</h2><p>Text of page {i}</p></div><div class="k4">All rights reserved</div></body>"""


def test_wrapper_alone_finds_unmarked_template(spark, monkeypatch):
    rows = [(i, f"http://p.example/{i}", PLAIN.format(i=i) if i < 8 else f"<body><p>other layout {i}</p></body>", "h", "r") for i in range(12)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string, reference string")
    got = X.extract(docs)
    assert got.columns == ["page_id", "url", "host", "reference", "text", "n_chars"]
    by = {r.page_id: (r.text, r.host, r.reference) for r in got.collect()}
    for i in range(12):
        assert by[i] == (f"Heading {i}\nText of page {i}" if i < 8 else f"other layout {i}", "h", "r")
    monkeypatch.setattr(X, "CONSTANT_PAGES", 1 << 30)
    assert "Shop" in {r.page_id: r.text for r in X.extract(docs).collect()}[1]


def test_class_names_never_empty_a_page():
    texts = lambda html: [b["text"] for b in X.page_blocks(html, html)]
    assert texts("<main><div class='share-capital related'><p>Capital rose.</p></div></main>") == ["Capital rose."]
    assert texts("<article><div id='comments-on-hegel'><p>Hegel wrote.</p></div></article>") == ["Hegel wrote."]
    assert texts("<main class='social science'><p>Society.</p></main>") == ["Society."]


NAMED = """<article><div class='article-header'><h1>Heading {i}</h1></div><p>Body {i} <span class='alert'>warned</span></p>
<div class='related-work'><h2>Related {i}</h2><p>others {i}</p></div><div class='box'><p>Ours since ever</p></div></article><div class="comments"><p>Nice {i}</p></div>"""


def test_names_inside_articles_are_not_heeded(spark, monkeypatch):
    rows = [(i, f"http://n.example/{i}", NAMED.format(i=i)) for i in range(10)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = "Heading {i}\nBody {i} warned\nRelated {i}\nothers {i}"
    assert {r.page_id: r.text for r in X.extract(docs).collect()} == {i: want.format(i=i) for i in range(10)}
    monkeypatch.setattr(X, "CONSTANT_PAGES", 1 << 30)  # without the wrapper the box stays
    assert {r.page_id: r.text for r in X.extract(docs).collect()} == {i: want.format(i=i) + "\nOurs since ever" for i in range(10)}


def test_names_of_most_of_a_page_are_not_heeded():
    texts = lambda html: [b["text"] for b in X.page_blocks(html, html)]
    prose = "All the prose of this page is here, and there is no more of it."
    assert texts(f"<body><p>x</p><div class='widget-area'><p>{prose}</p></div></body>") == ["x", prose]
    assert texts(f"<body><p>{prose}</p><div class='widget-area'><p>x</p></div></body>") == [prose]
    assert texts(f"<body><p>x</p><div id='comments'><p>{prose}</p></div></body>") == ["x"]


FIRST = "<body><div class='top'>Our paper</div><div class='text'><p>First {i}</p></div></body>"
SECOND = "<body><div class='text'><div class='inner'><p>Second {i}</p></div></div><div class='box'><p>Fixed box</p></div></body>"


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_layouts_of_one_host(spark, monkeypatch, limit):
    monkeypatch.setattr(X, "BROADCAST_BYTES", limit)
    rows = [(i, f"http://l.example/{i}", (FIRST if i < 30 else SECOND).format(i=i)) for i in range(50)]
    rows += [(i, f"http://l.example/{i}", f"<body><section class='s{i}' id='x'><p>rare {i}</p></section><nav>m</nav></body>") for i in range(50, 53)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"{'First' if i < 30 else 'Second' if i < 50 else 'rare'} {i}" for i in range(53)}
    assert {r.page_id: r.text for r in X.extract(docs).collect()} == want
    if limit > 0:  # with one reference for all, the box takes the slot of the other layout's text
        monkeypatch.setattr(X, "_layout", lambda html: F.lit(0).cast("long"))
        assert X.extract(docs).where("text LIKE '%Fixed box'").count() == 20


def test_constant_blocks_that_match_nothing(spark):
    """A box on a third of a layout's pages that the reference page may lack goes by its path of tags."""
    page = "<body><div class='text'><p>Text {i}</p>{box}</div></body>"
    rows = [(i, f"http://b.example/{i}", page.format(i=i, box="<blockquote><p>Fixed box</p></blockquote>" * (i % 3 == 0))) for i in range(30)]
    got = X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Text {i}" for i in range(30)}


def test_simple_tree_matching():
    a, b = X.number(X.parse("<div><p>a</p><ul><li>x</ul><p>b</p></div>")), X.parse("<div><ul><li>y</ul><p>c</p></div>")
    X.match(b, a)
    assert [s for s, _ in X.blocks(b)] == [s for s, t in X.blocks(a) if t in ("x", "b")]


def test_empty_table(spark):
    assert X.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
