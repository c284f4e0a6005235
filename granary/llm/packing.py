"""Operator 5: packing by non-negative least squares over length combinations.

Documents are tokenised and cut into windows of 1024 ids and a remainder. The
histogram of piece lengths (at most 1024 rows, whatever the corpus) goes to the
driver, which enumerates all combinations of up to three lengths that fill a
window exactly, solves for non-negative repeat counts whose lengths match the
histogram best in least squares, rounds them within what is there, and packs the
residual histogram greedily, largest fitting length first. The resulting list of
(combination, repeats) is bounded by the number of combinations, not by the data;
each piece finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map, written
from granary.llm.pieces import byte_tokenizer

WINDOW = 1024
SALT_ROWS = 200_000
LONG = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
PIECES = T.StructType([T.StructField(n, T.LongType()) for n in LONG])


def pieces(docs: DataFrame, tokenizer: str, ranks: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per piece: a document's ids and ``end_id``, cut every ``window`` ids (null text: empty)."""

    def make():
        tok, tail = byte_tokenizer(tokenizer, ranks), int(end_id).to_bytes(4, "little")

        def work(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                out: dict[str, list] = {n: [] for n in LONG}
                for doc, text in zip(ids[at : at + 256], texts[at : at + 256].to_pylist(), strict=True):
                    raw = memoryview(tok.ids(text or "") + tail)
                    total = len(raw) // 4
                    for start in range(0, total, window):
                        part = raw[4 * start : 4 * (start + window)]
                        for n, v in zip(LONG, (doc, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                            out[n].append(v)
                yield out

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, PIECES)


def combinations(window: int, depth: int = 3) -> np.ndarray:
    """All multisets of up to three lengths with sum ``window``, as rows padded with zeros."""
    found = [np.array([[window, 0, 0]])]
    if depth > 1:
        a = np.arange(1, window // 2 + 1)
        found.append(np.stack([window - a, a, 0 * a], 1))
    if depth > 2:
        for c in range(1, window // 3 + 1):
            b = np.arange(c, (window - c) // 2 + 1)
            found.append(np.stack([window - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(found)


def solve(histogram: np.ndarray, rows: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares min |A x - histogram| by accelerated projected
    gradients; column j of A counts the lengths in ``rows[j]``. A length's square counts
    by one over the combinations that hold it, so that all lengths are fitted alike."""
    n = len(histogram)

    def fill(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, k], x, n) for k in range(rows.shape[1])) * used

    used = np.ones(n)
    used[0] = 0
    # Rows of A have very unlike weights; scaled by them, each step fits all lengths alike.
    weight = 1 / np.maximum(fill(np.ones(len(rows))), 1)
    rate = 1 / rows.shape[1]
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        gap = (histogram - fill(y)) * weight * used
        new = np.maximum(0, y + rate * gap[rows].sum(1))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use each piece of the histogram exactly once."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    found: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], most: int) -> None:
        kinds, mult = np.unique(lengths, return_counts=True)
        if (repeats := min(most, int((left[kinds] // mult).min()))) > 0:
            left[kinds] -= repeats * mult
            found.append((lengths, repeats))

    if left[window]:
        take((window,), int(left[window]))
    if left.any():
        there = left > 0
        there[0] = True
        rows = combinations(window)
        rows = rows[there[rows].all(1)]
        if len(rows):
            x = np.rint(solve(left.astype(float), rows)).astype(np.int64)
            for j in np.argsort(-x, kind="stable"):
                if x[j] < 1:
                    break
                take(tuple(int(v) for v in rows[j] if v), int(x[j]))
    # Residuals: the longest piece, then the longest that still fits, in bulk.
    while (some := np.flatnonzero(left)).size:
        room, lengths = window, []
        spare = left.copy()
        while (fits := some[(some <= room) & (spare[some] > 0)]).size:
            lengths.append(int(fits[-1]))
            spare[fits[-1]] -= 1
            room -= lengths[-1]
        take(tuple(lengths), int(left.max()))
    return found


def pack(docs: DataFrame, tokenizer: str, ranks: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.

    Null text counts as empty (its piece is ``end_id`` alone); repeated rows each
    keep their own pieces, a null doc_id stays null; other columns are ignored; an
    empty table gives no rows. Sequences are numbered from 0 without gaps.
    """
    parts = written(pieces(docs, tokenizer, ranks, end_id, window), "pieces")
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    combos = plan(histogram, window)
    repeats = np.array([n for _, n in combos], np.int64)
    base = np.cumsum(repeats) - repeats
    # For each length, the slots that take it in order: combination, offset, ranks from/to.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    for j, (lengths, _) in enumerate(combos):
        at = 0
        for v in lengths:
            slots.setdefault(v, []).append((j, at))
            at += v
    tables = {}
    for v, s in slots.items():
        j, at = np.array(s, np.int64).T
        tables[v] = (base[j], at, np.cumsum(repeats[j]) - repeats[j])

    # Ranks by length: within (length, salt) by a window, plus what the salts before hold.
    salts = max(8, -(-sum(histogram.values()) // SALT_ROWS))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("inside", inside).join(counts, ["length", "salt"]).select(*LONG, (F.col("inside") + F.col("before")).alias("rank"))

    def make():
        def work(batch: pa.RecordBatch):
            cols = {n: batch.column(n) for n in LONG}
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                mine = np.flatnonzero(length == v)
                first, at, before = tables[int(v)]
                k = np.searchsorted(before, rank[mine], "right") - 1
                sequence[mine] = first[k] + rank[mine] - before[k]
                offset[mine] = at[k]
            yield cols | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}

        return work

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return arrow_map(ranked, make, schema)
