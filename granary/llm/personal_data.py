"""Operator 7: personal data by patterns and a skip-chain conditional random field.

Base patterns give certain spans. The nodes of a document's random field are all its
tokens that can be part of personal data: those with a digit, an @ or an inner full
stop, the words "at" and "dot" in brackets, and what stands beside these. Labels are
O, email, ip, card and phone; tokens of base spans are observed. A token has a
potential of its shape, and shares one with the token before it (near or far) and,
however distant, with the last token that repeats it or is similar: the same token,
the same digits in another spelling, the same local part or domain of an address.
Loopy message passing along all these edges gives each other token's label. Tokens
next to each other that get the same label become a span, after an exact check that
it can be one of its kind.

All potentials are log ratios of counts over the whole corpus, labelled by the base
patterns, with both outcomes: pairs of repeated or similar tokens that were labelled
alike, and those that were labelled differently or of which one cannot be what the
other is. A token without a label that could be is no evidence, as base patterns do
not know every spelling. The counts are a fixed set of shapes, kinds of links and
labels, so what reaches the driver does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: Tokens, before signs at their ends are cut off, and what may stand between near ones.
TOKEN = re.compile(r"[A-Za-z0-9._%+@/-]+")
DOTTED = re.compile(r"[A-Za-z0-9]\.[A-Za-z0-9]")
NUMBER = re.compile(r"\+?[0-9][0-9.+/-]*")
BETWEEN = frozenset(" ()[].-/+")
NEAR = 3

#: Kinds of links between distant tokens, and the pairs (alike, not alike) that count besides those of the corpus.
SKIPS = {"equal": (8.0, 1.0), "digits": (8.0, 1.0), "local": (8.0, 1.0), "short": (1.0, 1.0), "domain": (1.0, 1.0)}
EDGES = ("near", "far", *SKIPS)

#: Bounds of a potential (natural logarithm) and rounds of message passing.
UNARY_BOUND, SKIP_BOUND, ROUNDS = 3.0, 6.0, 30
CERTAIN = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds them, in
    linear time: each @ has at most one match, from where its local part begins."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, by start and kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(found)


class Token:
    """A node: its span, shape, base label (0 if none) and what it shares with tokens like it."""

    __slots__ = ("digits", "end", "keys", "label", "shape", "start", "word")

    def __init__(self, word: str, start: int, connects: bool):
        self.word, self.start, self.end, self.label = word, start, start + len(word), 0
        self.digits, low = "", word.lower()
        self.keys = [("equal" if len(word) >= 5 else "short", low)]
        if connects:
            self.shape, self.keys = "connects", []
        elif "@" in word:
            local, _, domain = low.rpartition("@")
            self.keys += [("local", local), ("domain", domain)]
            self.shape = f"address {'.' in domain}"
        elif NUMBER.fullmatch(word):
            groups = re.findall("[0-9]+", word)
            self.digits = "".join(groups)
            quad = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
            # What decides a base pattern (the plus sign, the dots) is no part of the shape.
            self.shape = f"number {min(len(self.digits), 20)} {min(len(groups), 5)} {quad} {len(self.digits) > 11 and luhn(self.digits)}"
        else:
            self.keys += [("local", low), ("domain", low)]
            self.shape = f"word {DIGIT.search(word) is not None} {DOTTED.search(word) is not None}"


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[Token]:
    """Nodes of a text in order, labelled by its base spans."""
    found: list[tuple[str, int, bool]] = []
    for m in TOKEN.finditer(text):
        word, start = m[0], m.start()
        left = word.lstrip("._%-/@+")
        if left and left[0].isdigit() and word[len(word) - len(left) - 1 : len(word) - len(left)] == "+":
            left = f"+{left}"
        start += len(word) - len(left)
        word = left.rstrip("._%+-/@")
        if word:
            end = start + len(word)
            found.append((word, start, word.lower() in ("at", "dot") and text[start - 1 : start] in ("[", "(") and text[end : end + 1] in ("]", ")")))
    near = lambda i: 0 <= i < len(found) and found[i][2]
    out = [Token(*x) for i, x in enumerate(found) if x[2] or near(i - 1) or near(i + 1) or "@" in x[0] or DIGIT.search(x[0]) or DOTTED.search(x[0])]
    merged: list[list[int]] = []
    for a, k, b in base:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, 1 + k])
    at = 0
    for t in out:
        while at < len(merged) and merged[at][1] <= t.start:
            at += 1
        if at < len(merged) and merged[at][0] < t.end:
            t.label = merged[at][2]
    # Numbers near each other may be one number: each shares the digits of all.
    at = 0
    while at < len(out):
        to = at + 1
        while to < len(out) and out[at].digits and out[to].digits and beside(text, out[to - 1], out[to]):
            to += 1
        digits = "".join(t.digits for t in out[at:to]) if to - at <= 20 else ""
        if 7 <= len(digits) <= 20:
            for t in out[at:to]:
                t.keys.append(("digits", digits[-9:]))
        at = to
    return out


def beside(text: str, a: Token, b: Token) -> bool:
    """Whether only a few signs and spaces stand between two tokens."""
    return b.start - a.end <= NEAR and BETWEEN.issuperset(text[a.end : b.start])


def links(text: str, nodes: list[Token], every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) and their kinds: to the token before, and to the last token with the
    same key. Two tokens that share several keys have one edge, of the strongest kind,
    or with ``every`` one of each."""
    edges, kinds, seen = [], [], {}
    for j, t in enumerate(nodes):
        if j:
            edges.append((j - 1, j))
            kinds.append(0 if beside(text, nodes[j - 1], t) else 1)
        met = set()
        for key in t.keys:
            if (i := seen.get(key)) is not None and (every or i not in met):  # kinds stand in order of their strength
                met.add(i)
                edges.append((i, j))
                kinds.append(EDGES.index(key[0]))
            seen[key] = j
    return np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


def groups(text: str, nodes: list[Token]) -> list[tuple[int, int]]:
    """For each node, what may be one mention with it: numbers beside each other, and what "at" and "dot" in brackets join."""
    joins = lambda a, b: beside(text, a, b) and bool(a.digits and b.digits or a.shape == "connects" or b.shape == "connects")
    out, at = [], 0
    while at < len(nodes):
        to = at + 1
        while to < len(nodes) and joins(nodes[to - 1], nodes[to]):
            to += 1
        out += [(nodes[at].start, nodes[to - 1].end)] * (to - at)
        at = to
    return out


def counted(text: str) -> Counter:
    """(kind of count, key, label, label) of one text."""
    nodes = tokens(text, base_spans(text))
    out: Counter = Counter(("shape", t.shape, t.label, 0) for t in nodes)
    spans = None
    for (i, j), kind in zip(*links(text, nodes, every=True), strict=True):
        a, b = nodes[i].label, nodes[j].label
        if kind < 2:
            out["chain", EDGES[kind], a, b] += 1
        elif a and b:
            out["skip", EDGES[kind], int(a == b), 0] += 1
        elif a or b:
            spans = spans or groups(text, nodes)
            low, high = spans[j if a else i]
            if high - low > 200 or not possible(max(a, b) - 1, text[low:high]):
                out["skip", EDGES[kind], 0, 0] += 1
    return out


COUNTS = T.StructType([T.StructField("what", T.StringType()), T.StructField("key", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """Counts over all texts; at most a few hundred shapes times five labels."""

    def make():
        def work(batch: pa.RecordBatch):
            total: Counter = Counter()
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0)[at : at + 256].to_pylist():
                    if text and ("@" in text or DIGIT.search(text) or BRACKETED.search(text)):
                        total.update(counted(text))
            rows = [(*k, n) for k, n in total.items()]
            yield dict(zip(COUNTS.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in COUNTS.names}

        return work

    return arrow_map(docs.select(F.col("text").cast("string")), make, COUNTS).groupBy("what", "key", "a", "b").agg(F.sum("n").alias("n"))


class Field:
    """The random field's potentials, and its posterior labels for one document."""

    def __init__(self, rows: list[tuple[str, str, int, int, int]], skipping: bool = True):
        n = len(LABELS)
        shape: dict[str, np.ndarray] = defaultdict(lambda: np.ones(n))
        chain = {k: np.ones((n, n)) for k in ("near", "far")}
        skip = {k: list(v) for k, v in SKIPS.items()}
        for what, key, a, b, count in rows:
            if what == "shape":
                shape[key][a] += count
            elif what == "chain":
                chain[key][a, b] += count
            else:
                skip[key][1 - a] += count
        center = lambda v: np.clip(np.log(v) - np.log(v).max(), -UNARY_BOUND, 0)
        self.shape = {k: center(v) for k, v in shape.items()}
        self.unknown = center(np.array([np.e**2, 1, 1, 1, 1]))
        self.tables = []
        for k, bound in (("near", 2), ("far", 1)):
            joint = chain[k] / chain[k].sum()
            self.tables.append(np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0))), -bound, bound))
        for k in SKIPS:
            # Tokens alike share a label; where the corpus says they do not, they are as good as not linked.
            alike = float(np.clip(np.log(skip[k][0] / skip[k][1]), 0, SKIP_BOUND)) if skipping else 0.0
            self.tables.append(np.where(np.eye(n, dtype=bool), alike, 0.0))

    def posterior(self, unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Sum-product loopy messages along ``edges`` (i, j) of ``kinds``; a row of label probabilities for each node."""
        n, e = len(unary), len(edges)
        ends = np.concatenate((edges, edges[:, ::-1]))  # message k goes from ends[k, 0] to ends[k, 1]
        back = np.concatenate((np.arange(e, 2 * e), np.arange(e)))
        both = np.concatenate((kinds, kinds + len(self.tables)))
        own = [(np.flatnonzero(both == k), np.exp(w)) for k, w in enumerate((*self.tables, *(w.T for w in self.tables)))]
        own = [(at, w) for at, w in own if len(at)]
        message = np.zeros((2 * e, len(LABELS)))
        for _ in range(ROUNDS + n.bit_length()):
            into = unary.copy()
            np.add.at(into, ends[:, 1], message)
            out = into[ends[:, 0]] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(message)
            for at, w in own:
                new[at] = np.log(out[at] @ w)
            new -= new.max(1, keepdims=True)
            change = np.abs(new - message).max(initial=0)
            message = 0.5 * message + 0.5 * new
            if change < 1e-4:
                break
        into = unary.copy()
        np.add.at(into, ends[:, 1], message)
        p = np.exp(into - into.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans (start, kind, end) beyond the base ones."""
        if not DIGIT.search(text) and "@" not in text and not BRACKETED.search(text):
            return []
        nodes = tokens(text, base)
        if all(t.label for t in nodes):
            return []
        unary = np.array([self.shape.get(t.shape, self.unknown) for t in nodes])
        for i, t in enumerate(nodes):
            if t.label:
                unary[i] = -30.0
                unary[i, t.label] = 0.0
        p = self.posterior(unary, *links(text, nodes))
        label = np.where(p.max(1) > CERTAIN, p.argmax(1), 0)
        label[[i for i, t in enumerate(nodes) if t.label]] = 0
        for i, t in enumerate(nodes[1:-1], 1):  # "at" between two parts of an address is part of it
            if t.shape == "connects" and label[i - 1] == label[i + 1] == 1:
                label[i] = 1
        out, at = [], 0
        while at < len(nodes):
            to = at + 1
            while to < len(nodes) and label[at] and label[to] == label[at] and beside(text, nodes[to - 1], nodes[to]):
                to += 1
            if label[at]:
                start, end = nodes[at].start, nodes[to - 1].end
                if text[start - 1 : start] == "(" and ")" in text[start:end]:
                    start -= 1
                if possible(int(label[at]) - 1, text[start:end]):
                    out.append((start, int(label[at]) - 1, end))
            at = to
        return out


BRACKETED = re.compile(r"[\[(](?:at|dot)[\])]", re.IGNORECASE)
AT, DOT = re.compile(r"@|[\[(]at[\])]", re.IGNORECASE), re.compile(r"\.|[\[(]dot[\])]", re.IGNORECASE)


def possible(kind: int, body: str) -> bool:
    """Whether a span can be of its kind, however it is spelled."""
    groups = re.findall("[0-9]+", body)
    digits = "".join(groups)
    if kind == 0:
        at = AT.search(body)
        return at is not None and DOT.search(body, at.end()) is not None
    if kind == 1:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def field(docs: DataFrame, skipping: bool = True) -> Field:
    """Potentials from all of ``docs``; without ``skipping`` distant tokens are not linked, for comparison."""
    return Field([tuple(r) for r in corpus_counts(docs).collect()], skipping)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


def found(docs: DataFrame, skipping: bool = True) -> DataFrame:
    """doc_id, counts of base matches, a digest of them, all spans, and how many the field added.

    Null and empty texts have no spans. Positions are code points, ends exclusive.
    Base spans of different kinds may overlap; added ones overlap none. Texts are
    read whole; repeated rows and null doc_ids are kept as rows, other columns
    ignored, an empty table gives no rows.
    """
    crf = field(docs, skipping)

    def row(doc, text: str | None):
        base = base_spans(text or "")
        spans = sorted(base + (crf.added(text, base) if text else []))
        return doc, *(sum(k == x for _, k, _ in base) for x in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)

    def make():
        def work(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                rows = [row(*x) for x in zip(ids[at : at + 256], texts[at : at + 256].to_pylist(), strict=True)]
                yield dict(zip(FOUND.names, map(list, zip(*rows, strict=True)), strict=True))

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, FOUND)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by <KIND> of its first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``, all other columns as they were."""
    crf, schema = field(docs), docs.schema
    column = schema.names.index("text")

    def run(batches):
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(column)[at : at + 256].to_pylist():
                    base = base_spans(text) if text else []
                    out.append(masked(text, base + crf.added(text, base)) if text else text)
            yield batch.set_column(column, batch.schema.field(column), pa.array(out, batch.schema.field(column).type))

    return docs.mapInArrow(run, schema)
