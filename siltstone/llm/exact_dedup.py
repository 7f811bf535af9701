"""Exact dedup by skew-safe combining, in DataFrame functions alone.

1. Local: Spark's map-side aggregation collapses equal texts of one partition.
2. Salted: groups of (digest, salt, text) meet, so that a group of copies holding a third of all
   rows is spread over ``salts`` tasks.
3. Global: at most ``salts`` winners a text meet by digest.
Every stage groups by the whole normalised text, not by the digest alone. Two texts with one
digest are found in the global stage and raise an error; they never merge.

Defined cases: a null text is the empty text; an empty table gives an empty result; rows that
repeat a doc_id count as rows of the group, and all rows that carry the smallest doc_id are
marked kept; a null doc_id never wins over a number; very long texts are compared whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def copy_groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """(digest, keep_id, group_size) of each text that two rows or more hold."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select(
        "doc_id", "norm", F.sha2("norm", 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    )
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    by_digest = salted.drop("salt").repartition(shuffle_partitions(docs.sparkSession), "digest")
    texts = by_digest.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    merged = texts.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count("*").alias("texts"))
    size = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("bigint")).otherwise(F.col("n"))
    return merged.where(F.col("n") > 1).select("digest", "keep_id", size.alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Only texts with copies come back by a join; its sides are plain exchanges on the digest, so
    that adaptive execution can split the partition of a hot digest.
    """
    groups = cut(copy_groups(docs, salts), "copies")
    rows = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("digest"))
    joined = rows.join(groups, "digest", "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
