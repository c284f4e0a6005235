"""Operator 13 against a plain reading of its definition; SQL is compared with the other queries'."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from granary.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, low, high, percent=10):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, with features as texts."""

    def features(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10_000.0) / ((s[b] + 1.0) * (n_t + 10_000.0))))
    rows = []
    for (i, _), (n, f) in zip(docs, found, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long_enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(long_enough[: percent * len(long_enough) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def make(n):
    words = ["the", "Über", "of", "sea2", "中文", "X", "tide", "naïve", "it's", "a-b", "END."]
    return [(i, " ".join(words[(i * 7 + k * k) % len(words)] + ("" if k % 5 else str(i % 4)) for k in range(i % 60))) for i in range(n)]


@pytest.mark.parametrize("low,high", [(1, 1), (1, 3), (2, 2)])
def test_n_grams(spark, low, high):
    docs, target = make(400), ["the sea2 of tide", None, "", "Über it's the a-b " * 30]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = resampling.resampled(df, aim, low, high).collect()
    assert sorted(map(tuple, got)) == sorted(plain(docs, target, low, high))


def test_a_new_dictionary_changes_nothing(spark):
    docs, target = make(150), ["the sea2 of tide"]
    words = resampling.Words(10_000)
    kept, resampling.ENTRIES = resampling.ENTRIES, 3
    try:
        for _, text in docs:
            words.begin()
            [words[w] for w in WORD.findall((text or "").lower())]
            assert all(words.text[i] == w and words.bucket[i] == crc32(w.encode()) % 10_000 for w, i in words.items())
    finally:
        resampling.ENTRIES = kept


def test_edge_rows(spark):
    """Null and repeated ids, null, empty and very long texts, clashing columns, no target, no documents."""
    text = "tide and sea " * 10
    rows = [(1, text), (1, text), (1, text + "more"), (None, text), (2, None), (3, ""), (4, "... !!"), (5, "wave " * 200_000)] + [(i, text) for i in range(10, 30)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, rank int, bucket string")
    aim = spark.createDataFrame([], "item_id long, text string")
    key = lambda r: tuple(map(repr, r))
    got = resampling.resampled(df, aim)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, [], 1, 1), key=key)
    assert resampling.resampled(df.limit(0), aim).collect() == []
