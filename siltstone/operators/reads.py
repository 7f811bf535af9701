"""Reads over resolved rows: lookups, range and prefix scans, pages. All are plain filters, so that they reach the scan."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput


def get(view: DataFrame, bucket: int, key: Any, cf: str = "default") -> DataFrame:
    return view.where((F.col("bucket") == bucket) & (F.col("cf") == cf) & (F.col("key") == key))


def multi_get(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: pos, bucket, key. A row a position in it, also for repeated and missing keys."""
    distinct = view.join(wanted.select("bucket", "key").distinct(), ["bucket", "key"], "left_semi")
    return wanted.join(distinct, ["bucket", "key"], "left")


def between(start: Any = None, end: Any = None, column: str = "key") -> Column:
    """start inclusive, end exclusive; none is no bound."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= start)
    if end is not None:
        out = out & (F.col(column) < end)
    return out


def scan(view: DataFrame, start: Any = None, end: Any = None, bucket: int | None = None, cf: str = "default") -> DataFrame:
    """Rows of a range, to be ordered by key within their bucket by who reads them in order."""
    out = view.where((F.col("cf") == cf) & between(start, end))
    return out if bucket is None else out.where(F.col("bucket") == bucket)


def first_rows(view: DataFrame, n: int) -> DataFrame:
    """The first n rows of each bucket by key; Spark keeps n a bucket and task before the shuffle."""
    if n < 1:
        raise InvalidInput("a limit is at least 1")
    return view.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("key"))).where(F.col("place") <= n).drop("place")


def prefix_page(view: DataFrame, prefix: str, after: str | None = None, limit: int = 100, column: str = "key") -> DataFrame:
    """A page of keys with a prefix above ``after``, with has_more and next_start_after on each row."""
    if not 1 <= limit <= 1000:
        raise InvalidInput("a page holds 1 to 1000 rows")
    found = view.where(F.col(column).startswith(prefix))
    if after is not None:
        found = found.where(F.col(column) > after)
    page = found.orderBy(column).limit(limit + 1)  # at most 1001 rows from here on
    place = F.row_number().over(Window.orderBy(column))
    sized = page.withColumn("place", place).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)
    last = F.max(column).over(Window.partitionBy())
    return sized.withColumn("next_start_after", F.when(F.col("has_more"), last)).drop("place")
