"""Operator 9: the decoder against all readings, held-out accuracy, edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest

from granary.llm import toxicity as tox

BAD = ["idiot", "loser", "scum", "moron"]


def hide(word, rng):
    kind = rng.randrange(4)
    if kind == 0:
        return word.translate(str.maketrans({"i": "1", "o": "0", "s": "$", "e": "3"}))
    if kind == 1:
        return rng.choice([" ", ".", "-", "*"]).join(word)
    if kind == 2:
        return "".join(c * rng.choice([1, 3]) if i else c * 3 for i, c in enumerate(word))
    return word[:2] + rng.choice(".-_*") + word[2:]


def corpus(n, rng, hidden=0.5):
    syllables = ["ta", "ro", "mi", "len", "ka", "shu", "dor", "vi", "pel", "no"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                w = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), hide(w, rng) if rng.random() < hidden else w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows, labels = corpus(1200, rng)
    extra = [(2000, None, "x", 1.0), (2001, "", "x", 1.0), (None, "a scum and m0r0n", "x", 1.0), (2002, "taro " * 30000 + "l.o.s.e.r", "x", 1.0), (2003, "i d i o t and sss", "x", 1.0)]
    docs = spark.createDataFrame([(i, t, "en", 0.0) for i, t in rows] + extra, "doc_id long, text string, hits string, score double").repartition(4)
    marks = spark.createDataFrame([(i, t, None) for i, t in labels] + [(1, None, 1), (99999, 1, 1), (None, 1, 1), (3, labels[3][1], 0)], "doc_id long, toxic int, quality int")
    return docs, marks, dict(labels), {r.doc_id: r for r in tox.scored(docs, marks).collect()}


def test_held_out_rows_are_found(scored):
    _, _, labels, got = scored
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in labels)
    right = sum(got[i].predicted == labels[i] for i in held)
    assert right / len(held) > 0.97
    assert sum(got[i].predicted for i in held if not labels[i]) <= 2


def test_decoder_raises_held_out_recall(spark):
    """Toxic words plain in fitted rows and hidden in held-out ones: with the decoder found, without it missed."""
    rng = random.Random(4)
    rows, labels = corpus(1200, rng, 0)
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = [(i, " ".join(hide(w, rng) if i in held and w in BAD else w for w in t.split())) for i, t in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    toxic = {i for i, t in labels if t and i in held}
    recall, false = {}, {}
    for decoding in (True, False):
        found = {r.doc_id for r in tox.scored(docs, marks, decoding=decoding).collect() if r.predicted and r.held_out}
        recall[decoding], false[decoding] = len(found & toxic) / len(toxic), len(found - toxic)
    print("held-out recall and false alarms, with and without the decoder:", recall, false)
    assert recall[True] > 0.95 and recall[True] > recall[False] + 0.2 and false[True] <= 2, (recall, false)


def test_logistic_fit_is_at_the_optimum():
    """No coordinate's gradient of the ridged loss is left, the bias' included."""
    rng = np.random.default_rng(2)
    rows = [(sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist()), int(rng.random() < 0.3)) for _ in range(400)]
    w, b = tox.logistic(rows, 12, steps=3000)
    z = np.array([b + sum(w[i] for i in f) for f, _ in rows])
    gap = 1 / (1 + np.exp(-z)) - np.array([t for _, t in rows])
    gradient = [sum(g for g, (f, _) in zip(gap, rows, strict=True) if i in f) + tox.RIDGE * w[i] for i in range(12)]
    assert max(map(abs, gradient)) < 1e-2 and abs(gap.sum()) < 1e-2


def test_restored_words_reach_stems_and_homoglyphs_are_read():
    channel = tox.Channel(np.ones(tox.CODES**3), ["idiotic", "idiots", "scum"])
    assert "idiot*" in channel.features("an 1d1otic man among 1d1ots")
    assert "scum" in channel.features("sc\u0443m") or "scum" in channel.features("\u0455cum")
    assert tox.Channel(np.ones(tox.CODES**3), ["idiot"], decoding=False).features("1d1ot x") == {"d", "ot", "x"}


def test_edge_rows(scored):
    _, _, _, got = scored
    assert got[2000].score == got[2001].score and got[2000].predicted == 0
    assert got[None].predicted == 1 and not got[None].held_out and {"scum", "moron"} <= set(got[None].hits)
    assert "loser" in got[2002].hits and "idiot" in got[2003].hits


def test_empty_tables(scored, spark):
    docs, marks, _, _ = scored
    some = docs.where("doc_id < 40")
    assert sorted((r.doc_id, r.score) for r in tox.scored(some.union(some), marks).collect())[::2] == sorted((r.doc_id, r.score) for r in tox.scored(some.union(some), marks).collect())[1::2]
    assert tox.scored(docs.limit(0), marks).count() == 0
    assert {r.score for r in tox.scored(docs.where("doc_id < 5"), marks.limit(0)).collect()} == {0.5}


def test_decoder_finds_the_best_reading():
    rng = random.Random(3)
    counts = np.array([rng.randrange(50) for _ in range(tox.CODES**3)])
    channel = tox.Channel(counts, ["idiot"])
    code = lambda c: tox.CODE.get(c, tox.OTHER)
    for chunk in ["1d1o", "a.b", "aab", "l0$3", "b1-1", "é1a", "aaa", "1!"]:
        best = {}
        options = []
        for c in chunk:
            letters = [(c, 0.0)] if c.isalpha() else [(x, tox.SWAP) for x in tox.LOOKALIKES.get(c, "")]
            options.append([*letters, ("", tox.REPEAT if letters else tox.DROP)])
        for path in itertools.product(*options):
            text, price, ok = "", 0.0, True
            for c, before, (letter, p) in zip(chunk, " " + chunk, path, strict=False):
                can = [c] if c.isalpha() else list(tox.LOOKALIKES.get(c, ""))
                if not letter and can and c not in tox.SEPARATORS and c != before and text[-1:] not in can:
                    ok = False
                text, price = text + letter, price + p
            if ok:
                codes = [0, 0, *map(code, text), 0]
                total = price + sum(channel.log[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
                best[text] = max(best.get(text, -1e9), total)
        assert abs(best[channel.best(chunk)] - max(best.values())) < 1e-9, chunk


def test_trigram_counts(spark):
    docs = spark.createDataFrame([("Ab, ab!",), (None,), ("é a",)], "text string")
    got = {r.code: r.n for r in tox.trigram_counts(docs).collect()}
    at = lambda a, b, c: (a * tox.CODES + b) * tox.CODES + c
    assert got[at(0, 0, 1)] == 3 and got[at(0, 1, 2)] == 2 and got[at(1, 2, 0)] == 2 and got[at(0, 1, 0)] == 1
    assert got[at(27, 27, 0)] == 1


def test_long_words_take_linear_time():
    channel = tox.Channel(np.ones(tox.CODES**3), ["idiot"])
    for text in ("ab" * 200_000, "1" * 200_000, "a1" * 100_000, "a b " * 60_000 + "cc", "a." * 60_000 + "bb", "aaa" * 50_000):
        channel.features(text)


def test_look_alikes_at_the_end_and_after_signs():
    words = ["whore", "ass", "dyke", "shit", "idiot"]
    channel = tox.Channel(np.ones(tox.CODES**3), words)
    for text, word in [
        ("a whor3 b", "whore"), ("a55", "ass"), ("an a$$, so", "ass"), ("dyk3", "dyke"), ('say "sh1t" now', "shit"), ("f-1d1ot", "idiot"), ("x/1d1ot", "idiot"), ("(sh1t)", "shit"), ("(a$$)", "ass"),
        ("sh1t!", "shit"), ("1diot!!", "idiot"), ("id**iot", "idiot"), ("id--1ot", "idiot"), ("f**k", "fk"), ('"5id.iot"', "idiot"),
    ]:
        assert word in channel.features(text), text
    for text in ("a!" * 60_000, "(" * 100_000 + "a", "a" + "!" * 100_000, "a--" * 60_000 + "b", "1-" * 100_000, "--1" * 100_000):
        channel.features(text)
