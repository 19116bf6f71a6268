"""A corpus pipeline: quality classifier, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each stage's
result as Parquet and reads it again as the next one's docs. All stages but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import near_dedup, packing, quality_classifier, quality_rules, secret_scan
from sievemark.llm.common import materialize, read_table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go.

    Rows are judged by their texts alone (null: empty), so that repeated rows stay or go together and null ids are like
    others; all columns are kept. No rows in, no rows out.
    """
    return quality_classifier.keep(docs)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go; the trees learn from the labels of what is left.

    Null and empty texts go. Repeated rows stay or go together, null ids are like others (but learn nothing); all columns
    are kept. Without labels of both kinds the base rules alone decide. No rows in, no rows out.
    """
    return quality_rules.keep(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id.

    Of rows with one id and one text one stays; different texts under one id are one document and stay or go together.
    Rows without id are linked with nothing and all stay; so do texts without words. All columns are kept. No rows in, no
    rows out.
    """
    judged = near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id").distinct()
    unnamed = docs.filter("doc_id IS NULL")
    return docs.join(judged.filter("doc_id IS NOT NULL"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns).unionByName(unnamed)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are written over in the texts; n_chars follows.

    Every row stays, repeated ones and those without id too; null texts stay null and keep their n_chars. Other columns
    are as they were. No rows in, no rows out.
    """
    masked = secret_scan.mask_secrets(docs)
    length = F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return masked if length is None else masked.withColumn("n_chars", length)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of at most 4096 tokens: columns as by packing.pack().

    A null or empty text is one end token. Repeated rows and those without id are packed each. No rows in, no rows out.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: Trained models and the tokenizer aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
