"""Algebra of closed bucket ranges, routing of buckets to shards, and changes of ownership."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidInput

Range = tuple[int, int]


def normalise(ranges: list[Range]) -> list[Range]:
    """Sorted, with touching and overlapping ranges joined."""
    out: list[Range] = []
    for lo, hi in sorted(ranges):
        if lo > hi:
            raise InvalidInput(f"range {lo}..{hi}")
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def subtract(ranges: list[Range], gone: list[Range]) -> list[Range]:
    out = []
    for lo, hi in normalise(ranges):
        for a, b in normalise(gone):
            if b < lo or a > hi:
                continue
            if a > lo:
                out.append((lo, a - 1))
            lo = b + 1
            if lo > hi:
                break
        if lo <= hi:
            out.append((lo, hi))
    return out


def intersect(a: list[Range], b: list[Range]) -> list[Range]:
    return normalise([(max(x, u), min(y, v)) for x, y in a for u, v in b if x <= v and u <= y])


def covered(inner: list[Range], outer: list[Range]) -> bool:
    return not subtract(inner, outer)


def overlapping(a: list[Range], b: list[Range]) -> bool:
    return any(x <= v and u <= y for x, y in a for u, v in b)


def shrink(owned: list[Range], gone: list[Range]) -> list[Range]:
    """What a shard keeps when it gives up ranges; it may not give up all, nor what it has not."""
    if not covered(gone, owned):
        raise InvalidInput("a range is outside the shard")
    if not (kept := subtract(owned, gone)):
        raise InvalidInput("a shard keeps a bucket at least")
    return kept


def expand(owned: list[Range], source: list[Range], taken: list[Range]) -> list[Range]:
    """What a shard owns after it takes ranges of another's snapshot."""
    if not covered(taken, source):
        raise InvalidInput("a range is outside the source")
    if overlapping(taken, owned):
        raise Conflict("a range is owned already")
    return normalise([*owned, *taken])


def holds(ranges: Iterable[Range]) -> Column:
    """Whether the bucket lies in the ranges."""
    keep = F.lit(False)
    for lo, hi in ranges:
        keep = keep | F.col("bucket").between(lo, hi)
    return keep


def in_ranges(rows: DataFrame, ranges: list[Range]) -> DataFrame:
    """Rows whose bucket lies in the ranges: a filter that prunes partitions of a stored log."""
    return rows.where(holds(ranges))


def route(buckets: DataFrame, shards: DataFrame) -> DataFrame:
    """buckets (bucket) with the shards (shard, lo, hi) that own each, and whether it is owned, missing or overlapping.

    Ranges cover 65,536 buckets at most, so that they are unfolded and joined by equality.
    """
    owners = shards.select("shard", F.explode(F.sequence("lo", "hi")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("owners"), F.min("shard").alias("shard"))
    found = buckets.join(owners, "bucket", "left")
    state = F.when(F.col("owners").isNull(), "missing").when(F.col("owners") > 1, "overlap").otherwise("owned")
    return found.select("bucket", "shard", F.coalesce("owners", F.lit(0).cast("bigint")).alias("owners"), state.alias("state"))
