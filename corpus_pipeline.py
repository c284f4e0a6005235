"""Corpus pipeline: quality rules, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of ``documents``; where a stage edits ``text``,
``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import line_dedup, near_dups, packing, personal_data, quality
from granary.llm.common import dropped, table, written
from granary.llm.queries import tokenizer_file


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with n_chars of the text as it now is."""
    return docs.select(*(F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else c for c in columns))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality rules accept."""
    return quality.accepted(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: later repeats of runs of lines with 50 words or more go from the texts, whole."""
    return _measured(line_dedup.without_repeats(docs), docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group alike by 0.8 in shingles of five words."""
    return near_dups.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data is replaced by the name of its kind."""
    return _measured(personal_data.redacted(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", good),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
#: Compression ratios, random fields and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
