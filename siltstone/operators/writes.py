"""Mutations as rows of a log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidInput

LOG = "seq long, bucket int, cf string, key binary, col int, op string, v binary, exp long, schema_v int"


@dataclass
class WriteBatch:
    """Puts, deletes and merges that become visible together, numbered in order of issue."""

    schema_v: int = 0
    widths: dict[str, int] = field(default_factory=lambda: {"default": 1})
    ttl: int | None = None
    no_ttl: frozenset[str] = frozenset()
    ops: list[tuple] = field(default_factory=list)
    #: Whether TTLs count at all.
    expires: bool = True

    def put(self, bucket: int, key: bytes, col: int, v: bytes, cf: str = "default", ttl: int | None = None) -> WriteBatch:
        return self._add(bucket, cf, key, col, "put", v, ttl)

    def merge(self, bucket: int, key: bytes, col: int, v: bytes, cf: str = "default", ttl: int | None = None) -> WriteBatch:
        return self._add(bucket, cf, key, col, "merge", v, ttl)

    def delete(self, bucket: int, key: bytes, col: int, cf: str = "default") -> WriteBatch:
        return self._add(bucket, cf, key, col, "delete", None, None)

    def _add(self, bucket: int, cf: str, key: bytes, col: int, op: str, v: bytes | None, ttl: int | None) -> WriteBatch:
        if cf not in self.widths:
            raise InvalidInput(f"no column family {cf}")
        if not 0 <= col < self.widths[cf]:
            raise InvalidInput(f"column {col} is outside the {self.widths[cf]} of {cf}")
        if not 0 <= bucket < 1 << 16:
            raise InvalidInput(f"bucket {bucket}")
        self.ops.append((bucket, cf, key, col, op, v, self.ttl if ttl is None else ttl))
        return self

    def tuples(self, first_seq: int, now: int) -> list[tuple]:
        """The batch as rows of a log; a family without TTL and a delete never expire."""
        out = []
        for i, (bucket, cf, key, col, op, v, ttl) in enumerate(self.ops):
            exp = None if ttl is None or not self.expires or cf in self.no_ttl or op == "delete" else now + ttl
            out.append((first_seq + i, bucket, cf, bytearray(key), col, op, None if v is None else bytearray(v), exp, self.schema_v))
        return out

    def rows(self, spark: SparkSession, first_seq: int, now: int) -> DataFrame:
        return spark.createDataFrame(self.tuples(first_seq, now), LOG)
