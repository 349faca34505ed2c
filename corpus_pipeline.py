"""A training corpus out of raw documents: five stages, each over all that the one before kept.

All stages: null texts count as empty, rows with a null id are never dropped as copies, columns
besides doc_id and text pass unchanged whatever they are called, and an empty table gives no rows.
Each reads whole texts a few hundred at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import exact, golay, packing, pii, quality
from wayfold.llm.common import small_reads, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: all rows with a score of 0.5 or more.

    Null and empty texts have the score of a text without any statistics. Repeated rows share
    their score, so they go or stay together. Without labels every row stays.
    """
    small_reads(spark)
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, trees)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for runs of white space: that of smallest doc_id, and one of rows that repeat it. Null and empty texts are one group."""
    small_reads(spark)
    return exact.exact_dedup(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of smallest doc_id, then of the smallest digest of its text, and one of rows that repeat both. Null and empty texts are one group."""
    small_reads(spark)
    return golay.near_dedup(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars, where there is one, follows the text unless it is null. Null and empty texts stay as they are; repeated rows change alike."""
    small_reads(spark)
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    changed = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(changed))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; a null or empty text is a piece of one token, and repeated rows are packed one by one."""
    small_reads(spark)
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the first, third and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
