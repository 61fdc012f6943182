"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Copies are merged in three steps: within each map task (partial aggregation), within a salt of a
digest, then over the salts. Each step groups by digest *and* by the whole normalised text, so two
texts that share a digest stay apart. A hot text sends one row for each map task at most.

Rows are led back to their group without their text: the merged texts of each digest are counted, and where
it is one, every row of that digest has that text. Rows of digests that several texts share are led back by
digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import keep_ids, measured

WIDE = "decimal(38,0)"
SPACES = " \t\n\x0b\x0c\r"


def TWO_64() -> Column:  # noqa: N802
    return F.lit("18446744073709551616").cast(WIDE)


def TWO_63() -> Column:  # noqa: N802
    return F.lit("9223372036854775808").cast(WIDE)


def normalised(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _rank(length: Column, doc_id: Column) -> Column:
    """One exact number that orders rows by length, then by smaller id. Fixed-width, so hash aggregation holds it in place."""
    return length.cast(WIDE) * TWO_64() - (doc_id.cast(WIDE) + TWO_63())


def _id_of(rank: Column) -> Column:
    """The id in a number that :func:`_rank` made."""
    return (F.pmod(-rank, TWO_64()) - TWO_63()).cast("bigint")


def winners(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each distinct normalised text: digest, norm, best (see :func:`_rank`), keep_id, group_size; dealt by digest.

    ``docs`` needs doc_id, norm, digest and length. The salt is the map task's, so that each task's
    copies of a text have met before the first shuffle.
    """
    salted = docs.withColumn("salt", F.spark_partition_id() % salts)
    local = salted.groupBy("salt", "digest", "norm").agg(F.max(_rank(F.col("length"), F.col("doc_id"))).alias("best"), F.count("*").alias("n"))
    merged = local.repartition("digest").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    return merged.withColumn("keep_id", _id_of(F.col("best")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest_chars: int = 64) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256 of its group of equal texts.

    Texts are equal when identical without white space. The longest original text stays, then the
    smallest id. Null text counts as empty; all empty texts form one group. Rows that repeat an id
    with the same text count in group_size each; each of them is marked kept if its id stays. A row
    with a null id is never the one that stays unless its group has no other id. An empty table gives
    an empty result. Very long texts are compared whole. Only the two named columns are read; others may have
    any name. Rows are dealt by the first ``digest_chars`` characters of the digest; how many changes no result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.length(text).cast("bigint").alias("length")).withColumn("sha", F.sha2("norm", 256))
    digest = F.col("sha") if digest_chars >= 64 else F.substring("sha", 1, digest_chars)
    merged = winners(rows.withColumn("digest", digest), salts)
    by_digest = merged.groupBy("digest").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    groups, (most,) = measured(by_digest, F.max("texts"))
    out = rows.select("doc_id", "sha", digest.alias("digest")).join(groups.where("texts = 1"), "digest").select("doc_id", "sha", "keep_id", "group_size")
    if (most or 0) > 1:
        several = merged.join(groups.where("texts > 1").select("digest"), "digest", "left_semi").select("norm", "keep_id", "group_size")
        out = out.unionByName(rows.select("doc_id", "sha", "norm").join(several, "norm").drop("norm"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull() & F.col("doc_id").isNull()).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that stay in their group of equal texts; rows with a null id all stay.

    Rows that repeat an id stay or go together. Empty texts are one group. An empty table stays empty.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_col)).distinct()
    return keep_ids(docs, kept, id_col)
