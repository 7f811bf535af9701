"""Scan plans: one split a shard, resumable at any (bucket, key)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.merge import Operators
from ..operators.ranges import holds
from ..operators.reads import between
from ..options import DEFAULT_SCAN, Config, ScanOptions


@dataclass(frozen=True)
class ScanSplit:
    """A shard's range of buckets, a range of keys, and places that it starts after or ends at."""

    lo: int
    hi: int
    start: Any = None
    end: Any = None
    after: tuple[int, Any] | None = None
    upto: tuple[int, Any] | None = None

    def condition(self) -> Column:
        out = F.col("bucket").between(self.lo, self.hi) & between(self.start, self.end)
        if self.after is not None:
            b, k = self.after
            out = out & ((F.col("bucket") > b) | ((F.col("bucket") == b) & (F.col("key") > k)))
        if self.upto is not None:
            b, k = self.upto
            out = out & ((F.col("bucket") < b) | ((F.col("bucket") == b) & (F.col("key") <= k)))
        return out

    def rows(self, view: DataFrame) -> DataFrame:
        return view.where(self.condition())

    def split_after(self, bucket: int, key: Any) -> tuple[ScanSplit, ScanSplit]:
        """What comes up to the place, and what comes after it."""
        if not self.lo <= bucket <= self.hi:
            raise InvalidInput(f"bucket {bucket} is outside the split")
        return replace(self, upto=(bucket, key)), replace(self, after=(bucket, key))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ScanSplit:
        d = json.loads(text)
        return cls(**d | {k: d[k] and tuple(d[k]) for k in ("after", "upto")})


@dataclass(frozen=True)
class ShardSplit:
    """A split of a global snapshot: one shard's snapshot and what of it is read; JSON that a worker can be sent."""

    path: str
    snapshot_id: int
    ranges: tuple[tuple[int, int], ...]
    start: bytes | None = None
    end: bytes | None = None
    after: tuple[int, bytes] | None = None
    upto: tuple[int, bytes] | None = None

    def split_after(self, bucket: int, key: bytes) -> tuple[ShardSplit, ShardSplit]:
        """What comes up to the place, and what comes after it; the split must have one range."""
        if len(self.ranges) != 1:
            raise InvalidInput("only a split of one range is split again")
        if not self.ranges[0][0] <= bucket <= self.ranges[0][1]:
            raise InvalidInput(f"bucket {bucket} is outside the split")
        return replace(self, upto=(bucket, key)), replace(self, after=(bucket, key))

    def scanner(self, spark: SparkSession, config: Config | None = None, options: ScanOptions = DEFAULT_SCAN, operators: Operators | None = None, clock: Any = None) -> DataFrame:
        """Its rows, in order of bucket and key."""
        from ..database import ReadOnly

        shard = ReadOnly(spark, self.path, self.snapshot_id, config, operators, clock)
        condition = holds(self.ranges)
        key = lambda k: F.lit(bytearray(k))
        for place, ahead in ((self.after, True), (self.upto, False)):
            if place is not None:
                b, k = place
                beyond = (F.col("bucket") > b) | ((F.col("bucket") == b) & (F.col("key") > key(k)))
                condition = condition & (beyond if ahead else ~beyond)
        return shard.view(options, self.start, self.end).where(condition).orderBy("bucket", "key")

    def to_json(self) -> str:
        hexed = lambda x: x.hex() if isinstance(x, bytes) else [x[0], x[1].hex()] if isinstance(x, tuple) and len(x) == 2 and isinstance(x[1], bytes) else x
        return json.dumps({k: hexed(v) for k, v in asdict(self).items()})

    @classmethod
    def from_json(cls, text: str) -> ShardSplit:
        d = json.loads(text)
        whole = lambda x: None if x is None else bytes.fromhex(x)
        place = lambda x: None if x is None else (x[0], bytes.fromhex(x[1]))
        return cls(d["path"], d["snapshot_id"], tuple(map(tuple, d["ranges"])), whole(d["start"]), whole(d["end"]), place(d["after"]), place(d["upto"]))


@dataclass(frozen=True)
class GlobalScanPlan:
    """A scan of a global snapshot: one split a shard."""

    snapshot: Any
    start: bytes | None = None
    end: bytes | None = None

    def splits(self) -> list[ShardSplit]:
        return [ShardSplit(s.path, s.id, s.ranges, self.start, self.end) for s in self.snapshot.shards]


@dataclass(frozen=True)
class ScanPlan:
    ranges: tuple[tuple[int, int], ...]
    start: Any = None
    end: Any = None

    def splits(self) -> list[ScanSplit]:
        return [ScanSplit(lo, hi, self.start, self.end) for lo, hi in self.ranges]
