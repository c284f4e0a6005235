"""Operator 7: base spans against the plain patterns, messages against enumeration."""

import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import personal_data as pd

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0 or kind == 3 and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


PART = st.sampled_from(["a", "b.c", "@", "x@y.z", ".", "_", "%", "1", "25", "255", "256", "0", "4111 1111 1111 1111", "79927398713", "+1 (017) 555-7713", "+", "(", ")", "-", " ", "é", "日", "\n", "1.2.3.4", "00001.2.3.4"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PART, max_size=25).map("".join))
def test_base_spans(text):
    assert pd.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000, "1 " * 200_000 + "1a", "a" * 300_000 + "@b.c"):
        base = pd.base_spans(text)
        pd.Field([]).added(text, base)
    assert base == [(0, 0, 300_004)]


def enumerated(unary, edges, tables):
    """Marginals of all labellings."""
    want = np.zeros_like(unary)
    for labels in itertools.product(range(5), repeat=len(unary)):
        p = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(tables[k][labels[i], labels[j]] for (i, j), k in edges))
        for i, x in enumerate(labels):
            want[i, x] += p
    return want / want.sum(1, keepdims=True)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5), st.randoms(use_true_random=False))
def test_messages_are_exact_on_trees(n, rng):
    field = pd.Field([])
    field.tables = [np.array([[rng.uniform(-2, 2) for _ in range(5)] for _ in range(5)]) for _ in range(3)]
    unary = np.array([[rng.uniform(-2, 2) for _ in range(5)] for _ in range(n)])
    edges = [((rng.randrange(i), i), rng.randrange(3)) for i in range(1, n)]
    got = field.posterior(unary, np.array([e for e, _ in edges]), np.array([k for _, k in edges]))
    assert np.abs(got - enumerated(unary, edges, field.tables)).max() < 1e-2


@settings(max_examples=40, deadline=None)
@given(st.randoms(use_true_random=False))
def test_messages_on_small_loopy_graphs(rng):
    """A chain with skips that close loops: near the true marginals, and the same labels where these are clear."""
    field = pd.Field([])
    unary = np.array([[rng.uniform(-1.5, 1.5) for _ in range(5)] for _ in range(6)])
    edges = [((i, i + 1), 1) for i in range(5)] + [((0, 3), 5), ((1, 4), 6), ((2, 5), 5)]
    field.tables = [t * 0.7 for t in field.tables]
    want = enumerated(unary, edges, field.tables)
    got = field.posterior(unary, np.array([e for e, _ in edges]), np.array([k for _, k in edges]))
    assert np.abs(got - want).max() < 0.15
    top = np.sort(want, 1)
    clear = top[:, -1] - top[:, -2] > 0.3
    assert (got.argmax(1) == want.argmax(1))[clear].all()


def respelled(rng):
    """(kind, as the base patterns know it, another spelling)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(pd.KINDS)
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return kind, f"+1 ({a}) {b}-{c}", rng.choice([f"{a}-{b}-{c}", f"({a}) {b}.{c}", f"{a} {b} {c}", f"1.{a}.{b}.{c}"])
    if kind == "ip":
        parts = [str(rng.randrange(1, 255)) for _ in range(4)]
        return kind, ".".join(parts), "-".join(parts)
    if kind == "card":
        digits = d(15)
        digits += next(x for x in "0123456789" if pd.luhn(digits + x))
        return kind, "-".join(digits[i : i + 4] for i in range(0, 16, 4)), "/".join(digits[i : i + 4] for i in range(0, 16, 4))
    name, host = f"{rng.choice(['jo', 'ann', 'lee'])}.{d(3)}", f"mail{d(2)}.example.com"
    return kind, f"{name}@{host}", rng.choice([f"{name} [at] {host}", f"{name}(at){host}"])


def test_added_spans_of_planted_respellings(spark):
    """Precision and recall beyond the base spans, among dates, amounts, versions and order numbers; and both without skip edges."""
    import random

    rng = random.Random(12)
    texts, want, first = [], {}, {}
    for i in range(1500):
        words = ["word"] * rng.randint(20, 60)
        # Numbers like the mentions' that nothing in the text repeats, and other tokens with digits.
        for _ in range(rng.randint(0, 4)):
            n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
            words[rng.randrange(len(words))] = rng.choice([f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{n(3)}-{n(3)}-{n(4)}", f"v1.{n(1)}.{n(2)}", f"{n(2)}.{n(2)}", f"order {n(10)}", f"file.{n(3)}.txt", f"section {n(1)}"])
        other = None
        if i % 3 == 0:
            _, base, other = respelled(rng)
            first[i] = base  # which a number before it can hide from the base patterns
            words.insert(rng.randrange(len(words)), base)
            if i % 2 == 0:
                words.insert(len(words) - rng.randrange(8), f"then {other} again")
                want[i] = other
            elif i % 4 == 1:
                words.append(base)
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    figures = {}
    for skipping in (True, False):
        right = wrong = 0
        hit = set()
        for r in pd.found(docs, skipping).collect():
            known = {(k, a, b) for a, k, b in brute(texts[r.doc_id])}
            for s in filter(None, r.spans.split(",")):
                kind, a, b = s.split(":")
                if (pd.KINDS.index(kind), int(a), int(b)) not in known:
                    body = texts[r.doc_id][int(a) : int(b)]
                    good = body in (want.get(r.doc_id), first.get(r.doc_id))
                    right, wrong = right + good, wrong + (not good)
                    hit |= {r.doc_id} if body == want.get(r.doc_id) else set()
        figures[skipping] = right / max(1, right + wrong), len(hit) / len(want)
    print("precision and recall of added spans, with and without skip edges:", figures)
    assert min(figures[True]) > 0.95 and figures[False][1] < figures[True][1] - 0.2, figures


def test_rows_consistency_and_masks(spark):
    phone = "+1 (017) 555-7713"
    texts = [
        None, "", "nothing here", f"call {phone} now. Later: 017-555-7713 or (017) 555.7713.", "mail jo.81@mail7.example.com, or jo.81 [at] mail7.example.com", "see 97.51.17.173 and 97-51-17-173",
        "order 12345678901234 of 2024-01-02 10:11:12", "9807915762804490 a 4111-1111-1111-1111; again 4111/1111/1111/1111", "x " * 30000 + phone,
    ] + [f"call {phone[:-1]}{i % 10} and {i}.2.3.4, {i}@b.co, {'4111111111111111'}" * 2 for i in range(50)]
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t in enumerate(texts)] + [(None, phone, None, 1)], "doc_id long, text string, spans string, n_ip int").repartition(3)
    got = {r.doc_id: r for r in pd.found(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        base = brute(text or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(pd.joined(base).encode()).hexdigest()
        assert set(filter(None, pd.joined(base).split(","))) <= set(r.spans.split(","))
    found = lambda i: [(s.split(":")[0], texts[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[i].spans.split(",") if s]
    assert found(3) == [("phone", phone), ("phone", "017-555-7713"), ("phone", "(017) 555.7713")]
    assert found(4) == [("email", "jo.81@mail7.example.com"), ("email", "jo.81 [at] mail7.example.com")]
    assert found(5) == [("ip", "97.51.17.173"), ("ip", "97-51-17-173")]
    assert found(6) == []
    assert ("card", "4111/1111/1111/1111") in found(7)
    clean = pd.redacted(docs)
    assert clean.schema == docs.schema
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[3] == "call <PHONE> now. Later: <PHONE> or <PHONE>." and out[0] is None and out[None] == "<PHONE>" and out[2] == texts[2]
    again = spark.createDataFrame([(1, phone), (1, phone), (None, phone), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_phone) for r in pd.found(again).collect()) == [("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    assert pd.found(docs.limit(0)).count() == 0 and pd.redacted(docs.limit(0)).count() == 0
