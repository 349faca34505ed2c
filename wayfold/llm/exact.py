"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, STAY, survivors, text_of


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit hash and, inside a group of one hash, by the bytes of the
    normalised text, so a collision of the hash never joins different texts. Both keys are
    pre-aggregated where the rows are read: a group of any size sends one row per task. The
    groups of two or more go back to the rows by hash and SHA-256 in a join that Spark may
    split where a key is hot.

    Null texts count as empty, and an empty text is a text like others. A null id never
    stays unless the group has no other; such rows are kept. Rows that repeat both id and
    text share their decision. Columns besides the two named ones are not looked at. An empty
    table gives no rows.
    """
    norm = docs.select(F.col(id_col).alias("_id"), normalised(text_of(text_col)).alias("_norm"))
    groups = (
        norm.select("_id", hash128(F.col("_norm")).alias("_hash"), "_norm")
        .groupBy("_hash", "_norm")
        .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
        .select("_hash", F.unhex(F.sha2("_norm", 256)).alias("_sha"), "_keep", "_size")
    )
    rows = norm.select("_id", hash128(F.col("_norm")).alias("_hash"), F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return rows.join(groups, ["_hash", "_sha"], "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of equal texts, with all its columns: the one of smallest id; see exact_duplicates.

    Of rows that repeat both that id and the text one stays. Rows without an id stay all. Null
    texts count as empty; columns pass unchanged, whatever they are called. An empty table gives
    no rows.
    """
    norm = normalised(text_of(text_col))
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    groups = known.groupBy(content_hash(F.col("_norm")).alias("_hash"), "_norm").agg(F.min("_id").alias("_keep"))
    stay = groups.select(F.col("_keep").alias(STAY[0]), F.unhex(F.sha2("_norm", 256)).alias(STAY[1]))
    return survivors(docs, stay, id_col, F.sha2(norm, 256))
