"""Queries that apply the operators to whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import alignment, licences, line_dedup, main_text, multiset_hash, near_dups, packing, personal_data, quality, resampling, sql, token_files, toxicity, transducer
from granary.llm.common import table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; read where it is installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.with_edits(table(spark, sf_dir, "documents"))


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found(table(spark, sf_dir, "documents"))


def op8_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_main_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dups": op1_minhash_near_dups,
    "op2_compression_bands": op2_compression_bands,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_winnowing_line_dedup": op4_winnowing_line_dedup,
    "op5_nnls_packing": op5_nnls_packing,
    "op6_multiset_hash": op6_multiset_hash,
    "op7_skip_chain_pii": op7_skip_chain_pii,
    "op8_licence_sentences": op8_licence_sentences,
    "op9_noisy_channel_toxicity": op9_noisy_channel_toxicity,
    "op10_token_files": op10_token_files,
    "op11_main_text_density": op11_main_text_density,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op1_minhash_near_dups": sql.NEAR_DUPLICATES,
    "op4_winnowing_line_dedup": sql.line_dedup_sql(),
    "op6_multiset_hash": sql.multiset_hash_sql(),
    "op8_licence_sentences": sql.licence_sql(),
    "op13_importance_resampling": sql.RESAMPLING,
}
