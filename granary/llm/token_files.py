"""Operator 10: token ids in frequency-ranked, byte-aligned, variable-length files.

Ids are replaced by their rank in the corpus's id counts (0 the most frequent).
A rank takes 1 to 4 data bytes; its length less one is a 2-bit code in a separate
stream of control bytes, four codes a byte. Decoding looks up each control byte in
a 256-row numpy table of lengths and gathers the data bytes of a whole block.

The file format is Parquet written by Spark (so that its commit protocol covers
lost executors): one row per block of whole documents in ascending doc_id order,
with the shard, the block number, the documents' ids and token counts, and the two
binary streams; a small table of ranks lies beside them.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map, dropped, shared_dir, written
from granary.llm.pieces import word_tokenizer

BLOCK_IDS = 1 << 18
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1

TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
BLOCKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType()),
])
DECODED = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "block", "doc_id", "before", "n_tokens", "ids_crc32")])


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of :func:`encode_ranks` for ``n`` ranks, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))
    out = np.zeros(n, np.uint32)
    for k in range(4):
        more = lengths > k
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, path: str, end_id: int, width: str) -> DataFrame:
    """doc_id and all ids (of numpy type ``width``) with ``end_id`` appended; null text: only that."""
    tail = np.array([end_id], width).tobytes()

    def make():
        tok = word_tokenizer(path)

        def narrow(text: str | None) -> bytes:
            return np.frombuffer(tok.ids(text or ""), "<u4").astype(width).tobytes() + tail

        def work(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                yield {"doc_id": ids[at : at + 256], "ids": list(map(narrow, texts[at : at + 256].to_pylist()))}

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, TOKENS)


def id_counts(tokens: DataFrame, width: str) -> DataFrame:
    """Occurrences of each id over all documents (at most the vocabulary's rows)."""

    def make():
        total = np.zeros(0, np.int64)

        def work(batch: pa.RecordBatch):
            nonlocal total
            for b in batch.column(0):
                got = np.bincount(np.frombuffer(b.as_buffer(), width))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
            some = np.flatnonzero(total)
            yield {"id": pa.array(some), "n": pa.array(total[some])}
            total = np.zeros(0, np.int64)

        return work

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
    return arrow_map(tokens.select("ids"), make, schema).groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, block_ids: int = BLOCK_IDS) -> str:
    """Encode every document and write blocks and ranks under ``path``; returns it.

    Null text counts as empty, so each row yields at least ``end_id``. Rows with a
    null doc_id come first; repeated doc_ids stay rows of their own, ordered by
    their ids. Other columns are ignored. Empty tables give empty files.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    width = "<u2" if word_tokenizer(tokenizer).library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"  # of ids between the steps
    tokens = written(tokenised(docs, tokenizer, end_id, width), "tokens")
    counts = sorted(id_counts(tokens, width).collect(), key=lambda r: (-r.n, r.id))  # at most one row for each id of the vocabulary
    by_rank = [r.id for r in counts]
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def make():
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0

        def work(batch: pa.RecordBatch):
            nonlocal block
            docs, raw, size, first = batch.column(0).to_pylist(), batch.column(1), 0, 0
            sizes = [len(b.as_buffer()) // np.dtype(width).itemsize for b in raw]
            for i, n in enumerate(sizes):
                size += n
                if size >= block_ids or i == len(sizes) - 1:
                    ids = np.frombuffer(b"".join(raw[first : i + 1].to_pylist()), width)
                    control, data = encode_ranks(rank_of[ids])
                    yield {"shard": [shard], "block": [block], "n_ids": [size], "doc_ids": [docs[first : i + 1]], "counts": [sizes[first : i + 1]], "control": [control], "data": [data]}
                    block, size, first = block + 1, 0, i + 1

        return work

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    arrow_map(ordered, make, BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    dropped(tokens)
    return path


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    by_rank = np.array([r.id for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def make():
        def work(batch: pa.RecordBatch):
            for row in batch.to_pylist():
                ids = by_rank[decode_ranks(row["control"], row["data"], row["n_ids"])] if row["n_ids"] else np.zeros(0, "<u4")
                ends = np.cumsum(row["counts"])
                before = ends - row["counts"]
                n = len(ends)
                yield {"shard": [row["shard"]] * n, "block": [row["block"]] * n, "doc_id": row["doc_ids"], "before": pa.array(before), "n_tokens": row["counts"], "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(before, ends, strict=True)]}

        return work

    decoded = arrow_map(blocks, make, DECODED)
    # Where blocks start: shards are few (one per file), blocks are summed within their shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = blocks.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("within"))
    at = inside.join(shards, "shard").select("shard", "block", (F.col("base") + F.col("within")).alias("base"))
    return decoded.join(at, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` and describe each document as read back."""
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, end_id))
