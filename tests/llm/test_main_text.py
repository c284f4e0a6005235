"""Operator 11 on made pages and against the marked articles of the tables' pages."""

import html
import re

import pytest

from granary.llm import main_text
from granary.llm.queries import QUERIES
from tests.duck import TESTDATA

LONG = "Words of a paragraph that goes on for some time, as articles do, and says more than one thing."
PAGES = {
    "plain text": ("only text &amp; a sign", "only text & a sign"),
    "unclosed": ("<p>a  b<p>c<br>d &lt;i&gt; <b>e", "a b\nc d <i> e"),
    "table and list": (f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y<ul><li>z</ul><li>w</ul></article>", f"{LONG}\na\nb\nc\nx\ny\nz\nw"),
    "cut in a tag": (f"<body><article><h1>T</h1><p>{LONG}</p><p cla", f"T\n{LONG}"),
    "cut in a reference": ("<p>a &am", "a &am"),
    "script with markup": (f"<script>if (a<b) x=\"</p><p>no\";</script><p>{LONG}</p><style>p > a {{}}</style><!-- <p>no</p> --><textarea><p>no</textarea>", LONG),
    "no names but density": (
        "<body><div>" + "".join(f'<div><a href="/{i}">Entry number {i}</a></div>' for i in range(12)) + f"</div><div><h1>Head</h1><div><p>{LONG}</p><p>{LONG} Again.</p><p>Short.</p></div></div>"
        + "<div>" + "".join(f'<span><a href="/{i}">more {i}</a> </span>' for i in range(9)) + "</div></body>",
        f"Head\n{LONG}\n{LONG} Again.\nShort.",
    ),
    "names": (
        f'<body class="has-sidebar"><header><h2>Site</h2></header><div id="topMenu"><a href="/">Home</a></div><div class="post-content with-sidebar"><h1>Head</h1><p>{LONG}</p><div class="ad-slot">Buy this thing now, it is cheap.</div><p>End.</p></div>'
        f'<div class="sidebar"><p>{LONG} no</p></div><section id="comments"><article><p>{LONG} no</p></article></section><div class="cookie-notice">no</div><form><p>no</p></form><div role="complementary">no</div><div hidden>no</div><footer>no</footer></body>',
        f"Head\n{LONG}\nEnd.",
    ),
    "article with its own header": (f"<header>no</header><article><header><h1>Head</h1></header><p>{LONG}</p><footer>no</footer></article>", f"Head\n{LONG}"),
    "unnamed advert": (f"<body><div><p>Buy this thing now, it is cheap and it is good for all of you.</p></div><div><h1>Head</h1>" + f"<p>{LONG}</p>" * 4 + "</div><div><a href=x>a</a></div></body>", "Head" + f"\n{LONG}" * 4),
    "two containers": ("<body><div>" + f"<p>{LONG} {LONG}</p>" * 4 + "</div><div>" + f"<p>{LONG} {LONG}</p>" * 4 + "</div><ul>" + "<li><a href=x>link</a>" * 9 + "</ul></body>", "\n".join([f"{LONG} {LONG}"] * 8)),
    "white space": ("<article><p>a&nbsp;&nbsp;b\t\n c</p>  <p> \u2003 </p><pre>d\n  e</pre></article>", "a b c\nd e"),
    "stray ends": (f"</div></p><div><p>{LONG}</b></i></span></div></div></div>", LONG),
    "nothing": ("<nav><a href=x>y</a></nav><script>z</script>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_made_page(name):
    source, want = PAGES[name]
    assert main_text.main_text(source) == want


def test_deep_page():
    assert main_text.main_text("<div>" * 50_000 + "deep" + "</div>" * 5 + "</x>" * 50_000) == "deep"


def test_greatest_sum_is_chosen():
    """The root is the node whose children's densities have the greatest sum, computed plainly."""
    page = main_text.Page(PAGES["no names but density"][0])
    body = page.tag.index("body")
    density, sums = main_text._densities(page, page.kept(), body)
    children = [[j for j in range(len(page.tag)) if page.parent[j] == i] for i in range(len(page.tag))]
    assert sums == pytest.approx([sum(density[j] for j in c) for c in children])
    assert sums.index(max(sums)) in main_text.main_nodes(page)


def test_whole_table(spark):
    """Every page's article as its marks give it, blocks by a plain split."""
    got = {r.page_id: r for r in QUERIES["op11_main_text_density"](spark, TESTDATA).collect()}
    pages = spark.read.parquet(f"{TESTDATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        want = "\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_edge_rows(spark):
    rows = [(1, "u", None, "x", 1), (1, None, "", "x", 2), (None, "u", "<p>a", "x", 3), (2, "u", "<p>a", "x", 3), (2, "u", "<p>a", "x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, main_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (1, None, "", 0), (None, "u", "a", 1), (2, "u", "a", 1), (2, "u", "a", 1)], key=repr)
    assert main_text.extract(pages.limit(0)).collect() == []
