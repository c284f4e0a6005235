"""Operator 1 against all pairs by brute force, and components against union-find."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import near_dups
from granary.llm.components import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def sets(texts, words):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        k = min(words, len(w)) or 1
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return out


def brute(texts, words, percent=80):
    s = sets(texts, words)
    ids = sorted(s)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return {i: len(v) for i, v in s.items()}, roots(ids, links)


@pytest.mark.parametrize("words", [2, 5])
def test_equals_all_pairs(spark, words):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}

    def add(text):
        texts[len(texts) * 3 + 1] = text

    for base in range(12):
        n = rng.choice([1, 2, 3, 8, 40, 200])
        ws = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(rng.randint(1, 14)):
            new = list(ws)
            for _ in range(rng.choice([0, 0, 1, 2, n // 12])):
                new[rng.randrange(n)] = rng.choice(vocabulary)
            add(rng.choice([" ", "\n", " \t "]).join(new) if base % 2 else " ".join(new).upper())
    # A chain in which neighbours link and ends do not, and a hub that links none of a bucket's rest.
    ws = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(25):
        ws = ws[4:] + [rng.choice(vocabulary) for _ in range(4)]
        add(" ".join(ws))
    for t in (None, "", " \n", "É é", "É É", "x" * 100_000, "x" * 100_000, "a " * 5000):
        add(t)
    docs = spark.createDataFrame([(i, t, "b", 7) for i, t in texts.items()] + [(None, "w1 w2 w3", "b", 7)], "doc_id long, text string, bands string, id int")
    sizes, want = brute(texts, words)
    rows = near_dups.near_duplicates(docs, words=words).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1
    assert got.pop(None)[1:] == (1 if words >= 3 else 2, None, True)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    kept = near_dups.one_of_each(docs, words=words)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} | {None}


def test_wide_bucket_of_unlinked_members(spark):
    """All share a long passage and so buckets, yet few link: every link must be found."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(70)]
    texts = {}
    for i in range(60):
        own = [f"o{i // 2}_{j}" for j in range(30)]
        if i % 2:
            own[rng.randrange(30)] = "zz"
        texts[i] = " ".join(common + own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, want = brute(texts, 2)
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, words=2).collect()} == want
    assert len(set(want.values())) == 30


def test_repeated_ids_and_empty_table(spark):
    """Rows that repeat a doc_id are documents of their own: brute force over rows."""
    rng = random.Random(5)
    base = [[f"v{k}_{rng.randrange(400)}" for _ in range(80)] for k in range(8)]
    rows = [(5, "a b c"), (5, "a b c"), (7, "a b c"), (7, "d e f g"), (2, None), (2, ""), (None, "a b c")]
    # 2 has a near copy of 1's text and a longer one unrelated to it; 3 is near that one.
    for k, (i, j) in enumerate([(1, 0), (2, 0), (2, 1), (3, 1), (4, 2), (4, 3), (6, 3), (6, 2), (9, 4), (9, 4), (8, 5)]):
        words = list(base[j]) if k % 2 == 0 else [w if x != k else f"new{k}" for x, w in enumerate(base[j])]
        rows.append((i, " ".join(words + ["longer"] * (j == 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, where = brute({k: t for k, (i, t) in enumerate(rows) if i is not None}, 2)
    name: dict[int, int] = {}
    for k, root in where.items():
        name[root] = min(name.get(root, rows[k][0]), rows[k][0])
    want = sorted((i, name[where[k]]) for k, (i, _) in enumerate(rows) if i is not None)
    got = near_dups.near_duplicates(docs, words=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == want
    assert {(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (6, 4), (7, 5), (7, 7)} <= set(want)
    kept = near_dups.one_of_each(docs.withColumn("content", F.lit(1)), words=2)
    assert kept.columns == ["doc_id", "text", "content"]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == sorted((i, t or "") for k, (i, t) in enumerate(rows) if i is not None and name[where[k]] == i)
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0 and near_dups.one_of_each(docs.limit(0)).count() == 0


def test_large_bucket_is_dealt_over_salts(spark, monkeypatch):
    """The same links with buckets of more than one salt."""
    monkeypatch.setattr(near_dups, "SALT_ROWS", 7)
    monkeypatch.setattr(near_dups, "HUBS", 5)
    monkeypatch.setattr(near_dups, "PROBES", (2,))
    test_wide_bucket_of_unlinked_members(spark)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots({x for e in links for x in e}, links)


def test_sketch_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    signer = near_dups.Signer()
    limit = near_dups.most_differing_bits(0.8, near_dups.BANDS * near_dups.ROWS, near_dups.SKETCH_BITS)
    far = 0
    for _ in range(300):
        e = rng.integers(0, 2**63, 900).astype(np.uint64)
        sketch = [signer(np.unique(x))[1] for x in (e[:800], e[100:900][:], np.concatenate((e[:200], e[:1] + np.arange(1, 600, dtype=np.uint64))))]
        bits = [sum(int(v).bit_count() for v in (sketch[0] ^ s).view(np.uint64)) for s in sketch[1:]]
        assert bits[0] <= limit  # 700 of 900 in common
        far += bits[1] > limit
    assert far > 290


def test_parity_bitmaps_never_rule_out_a_pair_at_the_threshold():
    """A bit differs only by an element that one set alone has, so the bound on sizes is exact."""
    rng = np.random.default_rng(3)
    for size in (1, 9, 150, 3000):
        base = near_dups.mix(rng.integers(0, 1 << 62, size).astype(np.uint64))
        for extra in (0, size // 9, size // 5):
            other = np.concatenate((base[extra:], near_dups.mix(rng.integers(0, 1 << 62, extra).astype(np.uint64))))
            flipped = int(np.bitwise_count(near_dups.parity(base, 1024) ^ near_dups.parity(other, 1024)).sum())
            assert flipped <= 2 * extra
            assert 180 * flipped <= 20 * (len(base) + len(other)) or 100 * (size - extra) < 80 * (size + extra)
