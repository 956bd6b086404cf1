"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; docs has the columns of documents
(more may come and are dropped by the first stage). run() writes what each stage returns as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm import mixing, packing, quality, simhash, substring_dedup
from lakeloom.llm.common import Saved, swept, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or that a learned rule rejects go; null texts are empty, so they go too."""
    rules = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 0.8 and more connect (Jaccard similarity of five-word shingles) one row
    stays: the smallest id's, of rows that repeat an id the text with the smallest digests, of equal texts of one id the
    smallest source, language and length. Rows without an id are members like others and come after all ids."""
    docs = docs.select(*COLUMNS)
    named = lambda c: (F.coalesce(c, F.lit(0)).alias("_key"), c.isNull().alias("_none"), "t1", "t2")
    key = ["_key", "_none", "t1", "t2"]
    first = simhash.similar(docs, Saved(spark, "near")).where("first").select(*named(F.col("doc_id"))).distinct()
    texts = docs.select("*", *simhash.text_digests(F.col("text"))).select(*COLUMNS, *named(F.col("doc_id")))
    kept = texts.join(first, key, "left_semi")
    order = W.partitionBy(*key).orderBy("source", "lang", "n_chars")
    return kept.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that start in a document with a smaller id go from the text; texts of which nothing is left
    go as a whole."""
    kept = substring_dedup.dedup(docs, Saved(spark, "substrings"), keep=("lang", "source", "n_chars"), texts=True)
    kept = kept.where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document has as many rows as the mix takes copies of it, from none to two. Each row of docs is judged as a row
    of its own, with or without an id."""
    mixed = mixing.mix(docs.select(*COLUMNS), Saved(spark, "mix"), keep=("text", "lang", "n_chars"))
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), copies)).alias("_one")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row for each piece of a document."""
    import public_tokenizers

    return packing.pack_documents(docs, Saved(spark, "pack"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL has no tokenizer and no rule learner: tests compare run() with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table documents."""
    saved = Saved(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with swept():
            docs = saved.put(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            saved.drop(f"stage{k - 1}")
    return docs
