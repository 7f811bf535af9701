"""Snapshots of shards and of all shards, their retention, and differences between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.merge import KEYS


def changed_keys(log: DataFrame, older: int, newer: int) -> DataFrame:
    """Keys with versions after one snapshot's seq up to another's, and how many."""
    return log.where((F.col("seq") > older) & (F.col("seq") <= newer)).groupBy(*KEYS).agg(F.count("*").alias("versions"))


def retained(snapshots: DataFrame, keep: int, current: int) -> DataFrame:
    """snapshots (id, retained) with whether automatic retention keeps each: the newest, the retained, the current."""
    newest = F.row_number().over(Window.orderBy(F.col("id").desc()))  # a row a snapshot: a small table
    return snapshots.withColumn("kept", (newest <= keep) | F.col("retained") | (F.col("id") == current))


def shard_descriptors(log: DataFrame, width: int) -> DataFrame:
    """Shards of ``width`` neighbouring buckets: range, last seq, versions and time."""
    shard = F.floor(F.col("bucket") / width).cast("long")
    return log.groupBy(shard.alias("shard")).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.max("seq").alias("last_seq"), F.count("*").alias("versions"), F.max("time").alias("time"))


def global_snapshot(shards: DataFrame) -> DataFrame:
    """One row over all shards; its watermark is the least of their times."""
    return shards.agg(F.count("*").alias("shards"), F.sum("versions").alias("versions"), F.min("time").alias("watermark"), F.sum(F.col("hi") - F.col("lo") + 1).cast("bigint").alias("buckets"))


def family_conflicts(families: DataFrame) -> DataFrame:
    """families (shard, name, id): names with two ids and ids with two names."""
    names = families.groupBy("name").agg(F.countDistinct("id").alias("n")).where("n > 1").select(F.lit("name").alias("kind"), F.col("name").alias("what"))
    ids = families.groupBy("id").agg(F.countDistinct("name").alias("n")).where("n > 1").select(F.lit("id").alias("kind"), F.col("id").cast("string").alias("what"))
    return names.unionByName(ids)
