"""Operator 2: quality rules with compression bands.

A document's UTF-8 bytes are compressed by zstandard as a whole and in fixed
chunks. Ratios (size before over size after) above an upper limit mean repetitive
text, below a lower one incompressible text. Short texts cannot compress far and
long ones compress further, so limits depend on the length. A document fails by
its whole ratio, or if chunks outside the chunk band hold more than a share of it.

Texts of two ``CHUNK`` or more are read in chunks of that size, shorter ones in the
greatest size of ``SHORT_CHUNKS`` that goes into them twice. The last chunk is
aligned to the end and counts for the bytes that no chunk before it holds, so each
byte counts once. Texts of less than two of the least size (256 bytes) are one
chunk, with the limits of the whole ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map
from granary.llm.words import SPACE, grams, hashed_words

#: (from so many bytes on, least ratio, greatest ratio) of a whole document. The upper limits
#: are the 98 % quantiles, rounded up, of some 5,000 files of plain prose of a Linux system
#: (licences, manual pages, read-me and copyright files, change logs) that pass the base rules,
#: and below 256 bytes follow their trend with room; none is fitted to labelled documents.
#: The lower limits leave prose of any script alone and lie above what random letters,
#: base 64 and hexadecimal digits in long runs compress to.
BANDS = (
    (0, 0.0, 2.6),
    (128, 0.9, 2.3),
    (256, 1.1, 2.1),
    (512, 1.25, 2.15),
    (1024, 1.35, 2.65),
    (2048, 1.4, 2.95),
    (4096, 1.45, 3.4),
    (8192, 1.5, 3.6),
    (16384, 1.5, 4.3),
    (32768, 1.5, 4.3),
    (65536, 1.5, 4.5),
    (262144, 1.5, 5.7),
)
#: (chunk of so many bytes, least ratio, greatest ratio): 95 % quantiles of the same files; the
#: chunk's size follows the text's length, so these limits do too.
CHUNK = 2048
CHUNK_BAND = (1.3, 3.5)
SHORT_CHUNKS = (
    (128, 0.98, 1.45),
    (256, 1.15, 1.75),
    (512, 1.3, 2.35),
    (1024, 1.45, 2.7),
)
#: Greatest share of a text's bytes in chunks outside their limits.
CHUNK_SHARE = 0.25
LEVEL = 3

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LETTER_START = (np.arange(256) & 0xC0) != 0x80
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("base_failed", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()), T.StructField("n_chunks", T.LongType()), T.StructField("n_chunks_outside", T.LongType()), T.StructField("kept", T.BooleanType()),
])


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    a = np.frombuffer(text, np.uint8)
    _, h = hashed_words(text)
    chars = int(np.count_nonzero(LETTER_START[a] & ~SPACE[a]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    g = grams(h, 8)
    repeated = 0
    if len(g) > 1:
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        if same.any():
            twice = np.zeros(len(g), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(h) + 1, np.int64)
            edge[: len(g)] += twice
            edge[8 : 8 + len(g)] -= twice
            repeated = int(np.count_nonzero(np.cumsum(edge)))
    return len(h), chars, int(np.count_nonzero(SYMBOLS[a])), len(lines) - len(set(lines)), repeated


class Bands:
    """Compression verdict of one text: (ratio, chunks, chunks outside, passes)."""

    def __init__(self, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE, level: int = LEVEL, short=SHORT_CHUNKS):
        import zstandard

        self.size = zstandard.ZstdCompressor(level=level).compress
        self.from_bytes = np.array([b[0] for b in bands])
        self.bands, self.share = bands, share
        self.chunks = [(chunk, *chunk_band), *sorted((x for x in short if x[0] < chunk), reverse=True)]

    def __call__(self, text: bytes) -> tuple[float, int, int, bool]:
        if not text:
            return 1.0, 0, 0, True
        ratio = len(text) / len(self.size(text))
        _, least, most = self.bands[int(np.searchsorted(self.from_bytes, len(text), "right")) - 1]
        chunk, low, high = next((c for c in self.chunks if len(text) >= 2 * c[0]), (len(text), least, most))
        n = outside = bytes_outside = 0
        for at in range(0, len(text), chunk):
            start = min(at, len(text) - chunk)  # the last chunk ends with the text
            r = chunk / len(self.size(text[start : start + chunk])) if chunk < len(text) else ratio
            n += 1
            if not low <= r <= high:
                outside, bytes_outside = outside + 1, bytes_outside + min(chunk, len(text) - at)
        return ratio, n, outside, least <= ratio <= most and bytes_outside <= self.share * len(text)


def scored(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, counts, base_failed, compression figures and ``kept`` for each row.

    Null and empty texts have no words: every count is 0, the base rule fails and
    they are not kept. A text of any length is read whole. Repeated rows and null
    doc_ids are kept as rows, other columns ignored, an empty table gives no rows.
    """

    def make():
        bands = Bands(**limits)

        def row(doc, text: str | None):
            raw = (text or "").encode("utf-8", "surrogatepass")
            n_words, chars, symbols, lines, repeated = counts(raw)
            failed = n_words < 20 or 100 * repeated > 30 * n_words
            ratio, n, outside, passes = bands(raw)
            return doc, n_words, chars, symbols, lines, repeated, failed, ratio, n, outside, passes and not failed

        def work(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                rows = [row(*x) for x in zip(ids[at : at + 256], texts[at : at + 256].to_pylist(), strict=True)]
                yield dict(zip(SCORES.names, map(list, zip(*rows, strict=True)), strict=True))

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCORES)


def accepted(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without the documents that a rule rejects, all columns as they were.

    Decisions are by row content: rows that share a doc_id are judged by their own
    text, in one pass and without a join.
    """
    schema = docs.schema
    text = [f.name for f in schema].index("text")

    def run(batches):
        bands = Bands(**limits)
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                for value in batch.column(text)[at : at + 256].to_pylist():
                    raw = (value or "").encode("utf-8", "surrogatepass")
                    n_words, *_, repeated = counts(raw)
                    keep.append(n_words >= 20 and 100 * repeated <= 30 * n_words and bands(raw)[3])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
