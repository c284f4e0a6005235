"""Operator 11: main text of web pages by composite text density.

Every page becomes a tree of its elements. A node's composite density is its
characters per tag, weighted by how few of its characters and tags are links:

    C/T * ln(C/L * T/K) / ln(ln(C/N * L + Lb/Cb * C + e))

with C characters, T tags, L and K those in links, N characters outside links, and Lb,
Cb those of the body; zeros count as one, and the last logarithm is at least ``FLAT``.
The node whose children's densities have the greatest sum holds the article. The least
density on the path from the body to it is the threshold that other parts of the page
must reach to belong to it too (an article in two containers); of each such part again the
subtree of the greatest sum is taken, if that is at least ``PART`` of the first.

What names itself as no part of an article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) is no node: by its tag, its role, or words of
its class or id. An ``article`` or ``main`` around the chosen node is taken whole, and the
last ``h1`` before it (where a page has none, the last ``h2`` on the path) belongs to it. ``header`` goes only outside of an article, where it is the
page's and not the article's.

Text is read in page order: character references decoded, white space inside a block
(``br`` is white space) as one space, blocks joined by a line feed. Pages are trees of any
depth, read without recursion; an end tag without its start is ignored, as is a tag cut
off at the page's end. Each page costs time in proportion to its length.

Edge cases: null and empty pages, and those without text, give an empty text; repeated
rows give their rows again; null ids and urls stay null; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map

FLAT = 0.05
#: Share of the greatest sum that another part of the page must reach to belong to the article.
PART = 0.5

# Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Start tag -> open elements that it ends, up to one that bounds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    **dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table"})),
    "tr": ({"tr", "td", "th"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select"})),
}
# What is no part of an article.
DROPPED = frozenset("nav aside footer form script style textarea title iframe noembed noframes noscript template svg math head button select input label dialog menu object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
HINTS = frozenset(
    "ad ads adv advert advertisement advertising adverts adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "related recommended recommendations share sharing social widget widgets pagination pager".split()
)
COMMENTS = frozenset("comment comments commentlist disqus discussion replies respond".split())
#: A name that begins so tells of what is elsewhere (has-sidebar).
ABOUT = frozenset("has no with without is js layout".split())
KEEPS = frozenset({"html", "body", "article", "main", "h1"})

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _aside(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element names itself as no part of an article: 2 for certain, 1 if no article is in it."""
    if tag in DROPPED or tag == "header" and not in_article:
        return 2
    found = 0
    for m in ATTRIBUTE.finditer(attributes) if attributes and tag not in KEEPS else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "role" and value.lower() in ROLES:
            found = 1
        for word in value.split() if name in ("class", "id") else ():
            words = [w.lower() for w in WORD.findall(word)]
            if words and words[0] not in ABOUT:
                if COMMENTS.intersection(words):
                    return 2
                if HINTS.intersection(words) or "header" in words and not in_article:
                    found = 1
    return found


class Page:
    """The tree of a page: nodes in page order, each with its parent, and texts between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.aside = ["html"], [-1], [0]
        #: (node, text) in page order; text is None where a block begins or ends.
        self.texts: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, lower = [0], 0, source.lower()
        #: How many elements of a name are open; whether a node is in an article.
        self.open, in_article = Counter(), [False]
        while m := TOKEN.search(source, at):
            if m.start() > at:
                self.texts.append((stack[-1], source[at : m.start()]))
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(stack, tag)
                continue
            if tag == "html" or tag == "body" and self.open["body"]:
                continue
            self._start(stack, tag)
            node, above = len(self.tag), stack[-1]
            self.tag.append(tag)
            self.parent.append(above)
            self.aside.append(_aside(tag, m[3], in_article[above]))
            in_article.append(in_article[above] or tag in ("article", "main"))
            if tag in BLOCKS:
                self.texts.append((node, None))
            elif tag == "br":
                self.texts.append((above, " "))
            if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?").search(lower, at)
                at = end.end() if end else len(source)
                continue
            stack.append(node)
            self.open[tag] += 1
        if at < len(source):
            self.texts.append((stack[-1], source[at:]))

    def _close(self, stack: list[int], depth: int) -> None:
        for node in reversed(stack[depth:]):
            self.open[self.tag[node]] -= 1
            if self.tag[node] in BLOCKS:
                self.texts.append((self.parent[node], None))
        del stack[depth:]

    def _start(self, stack: list[int], tag: str) -> None:
        """End what a start tag ends: head by body, a paragraph by any block, an item by the next."""
        if tag in BLOCKS and self.open["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[depth]]
                if name == "p":
                    self._close(stack, depth)
                    break
                if name in BLOCKS:
                    break
        if self.tag[stack[-1]] == "head" and tag in BLOCKS:
            self._close(stack, len(stack) - 1)
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            while any(self.open[x] for x in ended):
                depth = next(d for d in range(len(stack) - 1, -1, -1) if d == 0 or self.tag[stack[d]] in ended or self.tag[stack[d]] in bounds)
                if not depth or self.tag[stack[depth]] in bounds:
                    break
                self._close(stack, depth)

    def _end(self, stack: list[int], tag: str) -> None:
        """End the innermost open element of the name; one that is not a block ends no block."""
        if not self.open[tag]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[depth]]
            if name == tag:
                self._close(stack, depth)
                return
            if name in BLOCKS and tag not in BLOCKS:
                return

    def kept(self) -> list[bool]:
        """Whether a node and all above it may be part of an article. An element that only its
        class, id or role names as aside is kept if an h1, article or main is in it."""
        holds = [tag in ("h1", "article", "main") and not aside for tag, aside in zip(self.tag, self.aside, strict=True)]
        for i in range(len(holds) - 1, 0, -1):
            if holds[i]:
                holds[self.parent[i]] = True
        keep = [True] * len(self.tag)
        for i in range(1, len(keep)):
            keep[i] = keep[self.parent[i]] and (self.aside[i] == 0 or self.aside[i] == 1 and holds[i])
        return keep


def _densities(page: Page, keep: list[bool], body: int) -> tuple[list[float], list[float]]:
    """Composite density of every node, and the sum of its children's."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for node, text in page.texts:
        if text and keep[node] and (size := len("".join(text.split()))):
            chars[node] += size
            link_chars[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        if keep[i]:
            p = page.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    linked = link_chars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        if keep[i] and (c := chars[i]):
            t, l_, k, rest = max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i]), max(1, c - link_chars[i])
            few = math.log(max(1.0, c / l_ * t / k)) / max(FLAT, math.log(math.log(c / rest * link_chars[i] + linked * c + math.e)))
            density[i] = c / t * few
            if i:
                sums[page.parent[i]] += density[i]
    return density, sums


def main_nodes(page: Page) -> set[int]:
    """Roots of the subtrees that make up the article."""
    keep = page.kept()
    body = next((i for i, tag in enumerate(page.tag) if tag == "body"), 0)
    density, sums = _densities(page, keep, body)
    n, parent = len(page.tag), page.parent
    below = [i == body for i in range(n)]
    for i in range(body + 1, n):
        below[i] = keep[i] and below[parent[i]]
    # The greatest sum in each subtree, and where it is; the outermost and first of equals.
    best = list(range(n))
    for i in range(n - 1, body, -1):
        if below[i] and sums[best[i]] > 0 and (sums[best[i]], -best[i]) > (sums[best[parent[i]]], -best[parent[i]]):
            best[parent[i]] = best[i]
    chosen = best[body]
    path, at = [], chosen
    while at not in (body, -1):
        path.append(at)
        at = parent[at]
    threshold = min((density[i] for i in path), default=density[body])
    whole = next((i for i in reversed(path) if page.tag[i] in ("article", "main")), None)
    roots = {chosen if whole is None else whole}
    covered = [False] * n
    above = set(path) | {body}
    for i in range(body, n):
        covered[i] = i in roots or i > body and covered[parent[i]]
        if i > body and below[i] and not covered[i] and i not in above and path and density[i] >= threshold and sums[best[i]] >= PART * sums[chosen]:
            roots.add(best[i])
            covered[i] = True
    first = min(roots)
    for name in ("h1", "h2"):
        if title := [i for i in range(body, first) if page.tag[i] == name and below[i] and not covered[i] and (name == "h1" or parent[i] in above)]:
            return roots | {title[-1]}
        if name in page.tag:
            break
    return roots


def main_text(source: str | None) -> str:
    """The article of a page as text."""
    if not source:
        return ""
    page = Page(source)
    roots, keep = main_nodes(page), page.kept()
    taken = [False] * len(page.tag)
    for i in range(len(taken)):
        taken[i] = keep[i] and (i in roots or i > 0 and taken[page.parent[i]])
    blocks, words = [], []
    for node, text in page.texts:
        if text is None:
            blocks.append("".join(words))
            words = []
        elif taken[node]:
            words.append(text)
    blocks.append("".join(words))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

        return run

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), make, schema)
