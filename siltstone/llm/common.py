"""What the operators of this subpackage share: input columns, the shared folder, written cuts."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; whole texts travel in them, so both are kept far below Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) a folder of our own is made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back.

    Cuts the lineage so that a lost executor costs a reread, not a recomputation, and gives
    the planner real sizes: a join picks broadcast only under the session's size threshold.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) with null texts empty; further columns, whatever their names, are left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def id_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, data): the text as UTF-8 bytes, null as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


_HELD: dict[str, Callable[[], None]] = {}


def hold_memory(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called where a task begins: a Python worker serves many stages, and what earlier ones cached is let go.

    release: frees what this owner keeps from task to task. What is freed goes back to the system.
    """
    freed = [_HELD.pop(other) for other in [o for o in _HELD if o != owner]]
    for free in freed:
        free()
    if freed:
        give_back()
    if release is not None:
        _HELD[owner] = release


def give_back() -> None:
    """Hands what Python, Arrow and the C library keep for later back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def byte_views(column: pa.Array, kind: type = np.uint64) -> list[np.ndarray]:
    """The values of a binary column as arrays over Arrow's own memory, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [whole[a:b].view(kind) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
