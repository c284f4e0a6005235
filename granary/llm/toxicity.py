"""Operator 9: toxicity of deobfuscated text, by a noisy channel.

Words hidden by look-alike characters, spacing, separators or repeated letters are
restored before scoring. Each suspicious chunk spans a lattice: a character stands for
one of a few letters, a separator or a repeat may be dropped, each at a price. A
Viterbi search finds the path of best price plus probability under a character
trigram model, counted over all texts of the corpus and over the lexicon. The
restored words stand beside the plain ones wherever features are made, and both are
scored by a logistic model.

Features are words, and beginnings of words that make up a noticeable share of a
text, since some languages build a great many words on one stem. The lexicon (all
features that go with the label and have enough rows) and the model are fitted on at
most ``FIT_ROWS`` labelled rows outside the held-out part; labels enter nowhere else,
and no other column but the text is read for a score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map

#: Bound of the sample the classifier is fitted on, rows in order of a hash of doc_id.
FIT_ROWS = 20_000
#: The fewest labelled rows that support a feature, and the least weight that stays for the last fit.
LEAST_ROWS, LEAST_WEIGHT = 4, 0.05
THRESHOLD = 0.3
RIDGE = 0.2
#: A word's beginning is a feature at this length, from two words and so many in a thousand on.
STEM, STEM_WORDS, STEM_RATE = 5, 2, 6

#: Letters that a character can stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "°": "o", "µ": "u",
}
#: Letters of other scripts that look like Latin ones, read so inside words with Latin letters.
HOMOGLYPHS = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i", "\u0455": "s", "\u0458": "j", "\u04bb": "h", "\u0501": "d",
    "\u03b1": "a", "\u03b9": "i", "\u03bd": "v", "\u03bf": "o", "\u03c1": "p", "\u03c5": "u", "\u0131": "i",
}
SEPARATORS = " .-_*~'"
#: Prices (natural logarithm) of standing for another letter, of a dropped separator and of a dropped repeat.
SWAP, DROP, REPEAT = -0.5, -0.3, -0.3

_LOOK = re.escape("".join(LOOKALIKES))
WORD = re.compile(r"[^\W\d_]+")
#: Chunks worth decoding. Of one run without white space: look-alikes inside or before
#: letters; letters and look-alikes with at least one of each; such or plain runs joined
#: by separators; words with homoglyphs among Latin letters, or a letter three times over.
_SIGN = rf"(?:[^\W\d_]|[{_LOOK}])"
HIDDEN = re.compile(rf"^[^\W\d_]*+[{_LOOK}]++[^\W\d_]{_SIGN}*+|(?<![^\W\d_])[^\W\d_]++(?:[.\-_*~][^\W\d_]++)++")
MIXED = re.compile(rf"(?<![^\W_])(?<![{_LOOK}])(?=[^\W\d_]*+[{_LOOK}])(?=[{_LOOK}]*+[^\W\d_]){_SIGN}++")
JOINED = re.compile(rf"(?<![^\W_])(?<![{_LOOK}.\-_*~])(?=[{_LOOK}.\-_*~]*+[^\W\d_]){_SIGN}++(?:[.\-_*~]++{_SIGN}++)++")
FOREIGN = re.compile(f"(?=[^a-z]*+[a-z])[^{''.join(HOMOGLYPHS)}]*+[{''.join(HOMOGLYPHS)}]")
#: Across white space: words spelled out letter by letter.
SPELLED = re.compile(rf"(?<!\S){_SIGN}(?:[ .\-_*~]{{1,2}}{_SIGN}){{2,}}(?![^\W_])")
#: Look-alikes that also stand around words as signs.
MARKS = "".join(c for c in LOOKALIKES if not c.isalnum())
STRETCHED = re.compile(r"([^\W\d_])\1\1")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER, CODES = 27, 28


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Channel:
    """Character model and lattice decoder; ``counts`` are of trigrams of letter codes."""

    def __init__(self, counts: np.ndarray, lexicon: list[str], decoding: bool = True):
        self.decoding = decoding
        model = counts.astype(float).reshape(CODES, CODES, CODES)
        words = np.zeros_like(model)
        for w in lexicon:
            codes = [0, 0, *(CODE.get(c, OTHER) for c in w), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                words[a, b, c] += 1
        if words.sum() and model.sum():  # the lexicon weighs as much as the corpus
            words *= model.sum() / words.sum()
        model += words
        pairs = model.sum(0) + 0.5
        smooth = pairs / pairs.sum(1, keepdims=True)
        self.log = np.log((model + 2 * smooth[None]) / (model.sum(2, keepdims=True) + 2)).tolist()
        self.memo: dict[str, tuple[str, ...]] = {}
        self.plain: set[str] = set()  # chunks that hide nothing
        self.hidden: dict[str, tuple[str, ...]] = {}

    def decode(self, chunk: str) -> tuple[str, ...]:
        """Best words for a chunk: one reading with the separators dropped, and its parts between them."""
        got = self.memo.get(chunk)
        if got is None:
            whole = self.best(chunk)
            got = tuple(dict.fromkeys(w for w in (whole, *(self.best(p) for p in re.split(rf"[{re.escape(SEPARATORS)}]+", chunk) if len(p) > 1)) if w))
            if len(self.memo) < 100_000 and len(chunk) < 64:
                self.memo[chunk] = got
        return got

    def restored(self, chunk: str) -> set[str]:
        """Words that :meth:`decode` finds with or without the marks on either side of a
        chunk, and the one with signs at its ends dropped where that is better."""
        left, right = chunk.lstrip(MARKS), chunk.rstrip(MARKS)
        out = {w for c in {chunk, left, right, left.rstrip(MARKS)} if c for w in self.decode(c)}
        if not (chunk[0].isalpha() and chunk[-1].isalpha()):
            key = f"\n{chunk}"
            got = self.memo.get(key)
            if got is None:
                got = (self.best(chunk, edges=True),)
                if len(self.memo) < 100_000 and len(chunk) < 64:
                    self.memo[key] = got
            out.update(w for w in got if w)
        return out

    def best(self, chunk: str, edges: bool = False) -> str:
        """Best reading of a chunk; with ``edges``, signs before its first and after its last letter can be dropped."""
        final = max((i for i, c in enumerate(chunk) if c.isalpha()), default=-1) if edges else len(chunk)
        # state: last two letter codes -> (score, text so far as a linked list)
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for i, c in enumerate(chunk):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            readings = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in LOOKALIKES.get(c, "")]
            if c in HOMOGLYPHS:
                readings.append((HOMOGLYPHS[c], SWAP))
            for (a, b), (score, path) in states.items():
                for letter, price in readings:
                    k = CODE.get(letter, OTHER)
                    s = score + price + log[a][b][k]
                    if (b, k) not in new or s > new[b, k][0]:
                        new[b, k] = (s, (letter, path))
                # A separator, an unknown sign, or a letter again can be dropped.
                if not readings or c in SEPARATORS or c == before or (path and any(path[0] == x for x, _ in readings)):
                    s = score + (REPEAT if readings else DROP)
                    if (a, b) not in new or s > new[a, b][0]:
                        new[a, b] = (s, path)
                elif edges and not c.isalpha() and (i > final or not path):
                    s = score + DROP
                    if (a, b) not in new or s > new[a, b][0]:
                        new[a, b] = (s, path)
            states, before = new, c
        _, path = max(((s + log[a][b][0], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            letter, path = path
            out.append(letter)
        return "".join(reversed(out))

    def chunk(self, chunk: str) -> tuple[str, ...]:
        """Words that a lower-cased run without white space hides, besides its plain ones."""
        got = self.hidden.get(chunk)
        if got is None:
            words = WORD.findall(chunk)
            found: set[str] = set()
            if not chunk.isalpha():
                for m in HIDDEN.finditer(chunk):
                    found.update(self.decode(m[0]))
                for pattern in (MIXED, JOINED):
                    for m in pattern.finditer(chunk):
                        found.update(self.restored(m[0]))
            for w in [w for w in (*words, *found) if STRETCHED.search(w) or not w.isascii() and FOREIGN.match(w)]:
                found.update(self.decode(w))
            got = tuple(found.difference(words))
            if len(chunk) < 64:
                if not got and len(self.plain) < 300_000:
                    self.plain.add(chunk)
                elif got and len(self.hidden) < 100_000:
                    self.hidden[chunk] = got
        return got

    def features(self, text: str) -> set[str]:
        """Lower-cased words of a text, plain and restored, and frequent stems of both (marked by a star)."""
        text = text.lower()
        words = WORD.findall(text)
        out = set(words)
        stems = Counter([w[:STEM] for w in words])

        def take(restored: tuple[str, ...], times: int) -> None:
            out.update(restored)
            for w in restored:
                stems[w[:STEM]] += times

        if self.decoding:
            chunks = text.split()
            hiding = [(c, got) for c in set(chunks) - self.plain if (got := self.chunk(c))]
            if hiding:
                times = Counter(chunks)
                for c, got in hiding:
                    take(got, times[c])
            for m in SPELLED.finditer(text):
                take(tuple(w for w in self.decode(m[0]) if w), 1)
        least = max(STEM_WORDS, STEM_RATE * len(words) / 1000)
        out.update([stem + "*" for stem, k in stems.items() if k >= least and len(stem) == STEM])
        return out


_channels: dict[bytes, Channel] = {}


def channel_of(counts: np.ndarray, lexicon: list[str], decoding: bool = True) -> Channel:
    """The channel of these counts and words, kept by a Python worker from task to task, so its memos stay warm."""
    key = hashlib.sha256(counts.tobytes() + repr((sorted(lexicon), decoding)).encode()).digest()
    if key not in _channels:
        _channels.clear()
        _channels[key] = Channel(counts, lexicon, decoding)
    return _channels[key]


_codes = np.full(256, 0, np.int64)
_codes[[ord(c) for c in LETTERS]] = range(1, 27)
_codes[[ord(c) for c in LETTERS.upper()]] = range(1, 27)
_codes[0x80:] = OTHER


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): letter trigrams of all texts, a space before and after each word."""

    def make():
        def work(batch: pa.RecordBatch):
            total = np.zeros(CODES**3, np.int64)
            for at in range(0, batch.num_rows, 64):
                raw = "  ".join(t or "" for t in batch.column(0)[at : at + 64].to_pylist()).encode("utf-8", "surrogatepass")
                a = _codes[np.frombuffer(b"  " + raw + b"  ", np.uint8)]
                # Runs of other characters count as one boundary of two.
                gap = a == 0
                keep = ~(gap & np.concatenate(([False], gap[:-1])))
                a = a[keep]
                starts = np.flatnonzero(a == 0)
                b = np.insert(a, starts, 0)
                total += np.bincount(b[:-2] * CODES * CODES + b[1:-1] * CODES + b[2:], minlength=CODES**3)
            some = np.flatnonzero(total)
            yield {"code": pa.array(some), "n": pa.array(total[some])}

        return work

    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    return arrow_map(docs.select(F.col("text").cast("string")), make, schema).groupBy("code").agg(F.sum("n").alias("n"))


def corpus_model(docs: DataFrame) -> np.ndarray:
    counts = np.zeros(CODES**3, np.int64)
    for r in trigram_counts(docs).collect():  # at most 28^3 rows
        counts[r.code] = r.n
    return counts


def word_counts(sample: DataFrame, counts: np.ndarray, lexicon: list[str] | None = None, decoding: bool = True) -> DataFrame:
    """(word, n1, n0): sample rows of either label that have the feature."""

    def make():
        channel = channel_of(counts, lexicon or [], decoding)

        def work(batch: pa.RecordBatch):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(channel.features(text or ""))
            words = list(found[0] | found[1])
            yield {"word": words, "n1": [found[1][w] for w in words], "n0": [found[0][w] for w in words]}

        return work

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n1", T.LongType()), T.StructField("n0", T.LongType())])
    return arrow_map(sample.select("text", "toxic"), make, schema).groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


class Model:
    """Character model, lexicon weights and bias."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], bias: float):
        self.counts, self.weights, self.bias = counts, weights, bias
        self.lexicon = frozenset(weights)

    def score(self, words: set[str]) -> float:
        z = self.bias + math.fsum(self.weights[w] for w in self.lexicon & words)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def logistic(rows: list[tuple[list[int], int]], k: int, ridge: float = RIDGE, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of ``k`` present-or-not features and a bias, by accelerated gradients on the ridged logistic loss."""
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature = np.array([x for f, _ in rows for x in f], np.int64)
    y = np.array([t for _, t in rows], float)
    degree = np.bincount(feature, minlength=k)
    step = 1 / (0.25 * (degree + 1) * (1 + max((len(f) for f, _ in rows), default=0)) + ridge)
    step0 = 1 / (0.25 * len(rows) * (1 + max((len(f) for f, _ in rows), default=0)))
    w, b, w1, b1, t = np.zeros(k), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros(k), 0.0, 1.0
    w1, b1 = w.copy(), b
    for _ in range(steps):
        z = np.bincount(doc, w1[feature], len(rows)) + b1
        gap = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        new, newb = w1 - step * (np.bincount(feature, gap[doc], k) + ridge * w1), b1 - step0 * gap.sum()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w1, b1 = new + (t - 1) / after * (new - w), newb + (t - 1) / after * (newb - b)
        w, b, t = new, newb, after
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, decoding: bool = True) -> Model:
    """Model of the label ``toxic`` from ``docs`` outside the held-out part.

    At most ``fit_rows`` labelled ids are taken, in order of a hash; with none, the
    score is a constant half. What reaches the driver, features with ``LEAST_ROWS``
    rows of that sample and each row's list of them, is bounded by the sample. After
    a first fit, features of no weight go and the others and the bias are fitted again.
    """
    counts = corpus_model(docs)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    taken = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # At most fit_rows pairs of numbers, so the broadcast has a bound.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id").select("text", "toxic")
    sizes = {r.toxic: r.n for r in taken.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(counts, {}, 0.0)
    share = sizes[1] / (sizes[0] + sizes[1])
    n, n1 = F.col("n1") + F.col("n0"), F.col("n1")
    # How far the word's rows are from the label's share, in standard deviations.
    far = (n1 - n * share) / F.sqrt(n * share * (1 - share) + 1)
    best = lambda df: [r.word for r in df.where((n >= LEAST_ROWS) & (n1 > n * 2 * share)).orderBy(far.desc(), "word").collect()]
    first = best(word_counts(sample, counts, decoding=decoding))
    words = best(word_counts(sample, counts, first, decoding)) if decoding else first
    index = {w: i for i, w in enumerate(words)}

    def make():
        channel = channel_of(counts, words, decoding)

        def work(batch: pa.RecordBatch):
            found = [sorted(index[w] for w in channel.features(t or "") & index.keys()) for t in batch.column(0).to_pylist()]
            yield {"features": found, "toxic": batch.column(1)}

        return work

    schema = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("toxic", T.IntegerType())])
    data = sorted((list(r.features), r.toxic) for r in arrow_map(sample, make, schema).collect())  # at most fit_rows short lists
    if not data:
        return Model(counts, {}, 0.0)
    weights, _ = logistic(data, len(words))
    kept = [i for i in range(len(words)) if weights[i] > LEAST_WEIGHT]
    place = {i: k for k, i in enumerate(kept)}
    weights, bias = logistic([([place[i] for i in f if i in place], t) for f, t in data], len(kept))
    return Model(counts, {words[i]: float(weights[k]) for k, i in enumerate(kept)}, bias)


SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType()))])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, decoding: bool = True, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted and ``hits`` (lexicon words found) of each row.

    Null and empty texts have no words and get the model's bias as score. Texts are
    read whole. Rows with a null doc_id are scored and not held out; repeated rows
    are kept, other columns ignored, an empty table gives no rows. Labels of absent
    documents, null labels and repeated labels (the higher counts) are allowed.
    Without ``decoding`` hidden words stay as they are, for comparison.
    """
    model = fit(docs, labels, decoding=decoding, **fitting)

    def make():
        channel = channel_of(model.counts, sorted(model.weights), decoding)

        def work(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                found = [channel.features(t or "") & model.lexicon for t in texts[at : at + 256].to_pylist()]
                yield {"doc_id": ids[at : at + 256], "score": [model.score(w) for w in found], "hits": [sorted(w) for w in found]}

        return work

    out = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCORE)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
