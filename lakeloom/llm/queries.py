"""The queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, licenses, mixing, oracle, packing, quality, simhash, substring_dedup, suffix_dedup, toxicity, url_filter
from .common import Saved, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = Saved(spark, "op1")
    return saved.result(suffix_dedup.dedup(table(spark, sf_dir, "documents"), saved).drop("spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = Saved(spark, "op2")
    return saved.result(licenses.scan(table(spark, sf_dir, "documents"), saved))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    saved = Saved(spark, "op3")
    return saved.result(packing.pack_documents(table(spark, sf_dir, "documents"), saved, public_tokenizers.path("word_bpe_49k.json")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = Saved(spark, "op4")
    mixed = mixing.mix(table(spark, sf_dir, "documents"), saved)
    return saved.result(mixed.select("doc_id", "size", "source_size", "target", "taken"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.learned(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts and its base limits: the part of it that SQL can check."""
    judged = quality.judge(table(spark, sf_dir, "documents"), [])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = Saved(spark, "op6")
    found = simhash.groups(table(spark, sf_dir, "documents"), saved)
    return saved.result(found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = Saved(spark, "op7")
    return saved.result(url_filter.judge_pages(table(spark, sf_dir, "pages"), saved))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = Saved(spark, "op9")
    return saved.result(substring_dedup.dedup(table(spark, sf_dir, "documents"), saved))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = Saved(spark, "op10")
    return saved.result(embedding_dedup.dedup(table(spark, sf_dir, "embeddings"), saved))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_licenses": op2_licenses,
        "op3_packing": op3_packing,
        "op4_mixing": op4_mixing,
        "op5_quality": op5_quality,
        "op6_simhash": op6_simhash,
        "op7_url_filter": op7_url_filter,
        "op8_toxicity": op8_toxicity,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_embedding_dedup": op10_embedding_dedup,
        "quality_statistics": quality_statistics,
    }


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; tests compare the others with plain versions."""
    return {
        "op1_suffix_dedup": oracle.OP1,
        "op2_licenses": oracle.OP2,
        "op4_mixing": oracle.OP4,
        "op7_url_filter": oracle.OP7,
        "op9_substring_dedup": oracle.OP9,
        "op10_embedding_dedup": oracle.OP10,
        "quality_statistics": oracle.STATISTICS,
    }
