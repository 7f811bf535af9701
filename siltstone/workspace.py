"""Where queries that need a store of their own put it: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_store(spark: SparkSession, tag: str) -> str:
    """A path under spark.checkpoint.dir; only where that is unset, as in tests, under a folder of our own, which is then set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/stores/{tag}-{uuid.uuid4().hex}"
