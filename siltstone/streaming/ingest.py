"""Structured Streaming: mutations from a file source, a version of the store a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import LogStore


def ingest(
    spark: SparkSession, source: str, schema: str, store: LogStore, checkpoint: str, files_per_trigger: int = 8,
    as_log: Callable[[DataFrame], DataFrame] = lambda rows: rows, name: str = "ingest",
) -> None:
    """Appends all files of a folder to a store and returns when none are left.

    as_log: makes mutations of the source's rows; seq comes from the source, never from the batch.
    Each batch's number is kept in the manifest under the stream's name, so that a batch which is
    replayed after a crash is not added twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        store.append(as_log(batch), batch=(name, number))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(store: LogStore, version: int | None, checkpoint: int) -> DataFrame:
    """The log's tail behind a checkpoint's seq, for a reader that has what comes up to it."""
    return store.read(version).where(f"seq > {int(checkpoint)}")
