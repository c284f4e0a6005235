"""Operator 13: importance resampling towards a target by hashed n-grams.

A document's features are its runs of ``low`` to ``high`` words. Words get integers in a
dictionary, an n-gram is a tuple of these, and each distinct tuple of a batch is written
out and hashed into a bucket once; its bucket is then joined back to every place where it
stands. The dictionary and, for single words, its buckets stay with the Python worker
from task to task up to ``ENTRIES`` words, after which it begins anew; ids mean nothing
outside it, so nothing depends on where a text is read.

One pass writes each document's features summed by bucket and every batch's buckets as
one row. All documents' and all target texts' buckets are summed (``BUCKETS`` values at
most, the only thing that goes to driver and tasks), which gives each bucket's gain. Each document's
mean gain and its Gumbel noise, made from its id alone, are its score, and the documents
with the highest scores are drawn: they are numbered by range partitions in the order of
scores, and those numbered up to the share of all that are long enough are the draw. No
task sees all scores.

Edge cases: null and empty texts have no features and weight 0; a null id has the noise
of an empty id and comes last among equal scores; repeated rows are documents of their
own and may both be drawn; without documents there are no rows, without target texts all
gains follow from zero counts; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map, dropped, written
from granary.operators.numbering import numbered

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
ENTRIES = 500_000
#: The characters of a word (ASCII letters, digits and all beyond ASCII), in lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

COUNTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))])


class Words(dict):
    """word -> id; ``text`` and ``bucket`` go back from ids."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.text, self.bucket = buckets, [], []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self.text)
        self.text.append(word)
        self.bucket.append(crc32(word.encode()) % self.buckets)
        return i

    def begin(self) -> None:
        """Start anew if there are too many words."""
        if len(self.text) > ENTRIES:
            self.clear()
            self.text, self.bucket = [], []


@lru_cache(maxsize=2)
def dictionary(buckets: int) -> Words:
    """Kept by a Python worker from task to task."""
    return Words(buckets)


def features(words: Words, ids: np.ndarray, ends: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the document and bucket of every n-gram, of the word ids of documents that end at ``ends``."""
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    places, buckets = [], []
    for n in range(low, high + 1):
        last = len(ids) - n + 1
        if last <= 0:
            break
        whole = doc[:last] == doc[n - 1 :]
        at = np.flatnonzero(whole)
        if n == 1:
            bucket = np.array(words.bucket, np.int64)[ids]
        else:
            # Distinct tuples, one word more at a time: a prefix's number and the next word make a pair.
            number = ids[at].astype(np.int64)
            for k in range(1, n):
                _, first, number = np.unique(number * len(words.text) + ids[at + k], return_index=True, return_inverse=True)
            texts = (" ".join([words.text[i] for i in ids[at[x] : at[x] + n]]) for x in first)
            bucket = np.fromiter((crc32(t.encode()) % words.buckets for t in texts), np.int64, len(first))[number]
        places.append(doc[at])
        buckets.append(bucket)
    return (np.concatenate(places), np.concatenate(buckets)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def counted(docs: DataFrame, key: str, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, bucket, n) of every text: its buckets in order, and how many features each has."""

    def make():
        words = dictionary(buckets)

        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words.begin()
                found = [WORD.findall(t.translate(LOWER)) if t else [] for t in part.column("text").to_pylist()]
                ids = np.array([words[w] for f in found for w in f], np.int64)
                sizes = np.array(list(map(len, found)), np.int64)
                place, bucket = features(words, ids, np.cumsum(sizes), low, high)
                both, n = np.unique(place * buckets + bucket, return_counts=True)
                place, bucket = both // buckets, both % buckets
                offsets = np.searchsorted(place, np.arange(len(found) + 1)).astype(np.int32)
                total = np.concatenate(([0], np.cumsum(n)))[offsets]
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (bucket, n)]
                yield {"doc_id": part.column("doc_id"), "n_words": sizes, "n_features": np.diff(total), "bucket": lists[0], "n": lists[1]}

        return run

    return arrow_map(docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string")), make, COUNTED)


def bucket_sums(counts: DataFrame) -> DataFrame:
    """(bucket, n) over all texts; every batch adds up its own before anything is shuffled."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def make():
        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            bucket, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "n"))
            total = np.bincount(bucket, n).astype(np.int64) if len(bucket) else np.zeros(0, np.int64)
            some = np.flatnonzero(total)
            yield {"bucket": some, "n": total[some]}

        return run

    return arrow_map(counts.select("bucket", "n"), make, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: how much likelier a feature of it is in the target, in thousandths of a natural logarithm."""
    total = lambda df: F.coalesce(df.agg(F.sum("n").alias("n")).scalar(), F.lit(0))
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1.0) * (total(source).cast("double") + float(buckets)) / ((s + 1.0) * (total(target).cast("double") + float(buckets)))
    return both.select("bucket", F.floor(F.ln(ratio) * 1000.0).alias("gain"))


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of gains over a document's features."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def make():
        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            lists = batch.column("bucket")
            bucket, n = lists.flatten().to_numpy(zero_copy_only=False), batch.column("n").flatten().to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(gain[bucket] * n)))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            size = batch.column("n_features").to_numpy()
            weight = np.where(size > 0, np.diff(upto[ends]) // np.maximum(size, 1), 0)
            yield {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_features": batch.column("n_features"), "weight": weight}

        return run

    return arrow_map(counts, make, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def resampled(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null unless it is drawn.

    ``docs`` has doc_id and text, ``target`` item_id and text.
    """
    counts = written(counted(docs, "doc_id", low, high, buckets), "feature-counts")
    wanted = counted(target, "item_id", low, high, buckets)
    # As many numbers as there are buckets come to the driver and go to all tasks.
    gain = np.array([r.gain for r in gains(bucket_sums(counts), bucket_sums(wanted), buckets).sort("bucket").collect()], np.int64)
    scored = written(weighed(counts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    dropped(counts)
    long_enough = F.col("n_words") >= LEAST_WORDS
    order = [F.when(long_enough, F.col("score")).desc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    drawn = F.floor(scored.where(long_enough).agg(F.count("*").alias("n")).scalar() * percent / 100)
    placed = numbered(scored, order, "rank")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(long_enough & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
