"""Looking into a store: what web pages and a command line would ask, as functions that return plain values."""

from __future__ import annotations

import base64
import time
from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import functions as F

from .coordinator import Reader
from .database import Sample
from .errors import InvalidInput
from .options import ReadOptions, ScanOptions

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def decoded_key(text: str, encoding: str = "utf8") -> bytes:
    """A key given as text, hex digits or base64."""
    try:
        if encoding in ("utf8", "utf-8"):
            return text.encode()
        if encoding == "hex":
            return bytes.fromhex(text)
        if encoding in ("b64", "base64"):
            return base64.b64decode(text, validate=True)
    except ValueError as e:
        raise InvalidInput(f"not {encoding}: {text}") from e
    raise InvalidInput(f"no encoding {encoding}")


def shown(value: bytes | None) -> dict[str, str | None] | None:
    """Bytes as base64 and, where they are text, as text."""
    if value is None:
        return None
    try:
        text = value.decode()
    except UnicodeDecodeError:
        text = None
    return {"b64": base64.b64encode(value).decode(), "utf8": text}


def successor(prefix: bytes) -> bytes | None:
    """The least key above all that begin with the prefix; none if there is no such key."""
    short = prefix.rstrip(b"\xff")
    return short[:-1] + bytes([short[-1] + 1]) if short else None


def _page(rows: list[tuple[bytes, list]], more: bool) -> dict[str, Any]:
    items = [{"key": shown(k), "columns": [shown(c) for c in columns]} for k, columns in rows]
    return {"items": items, "has_more": more, "next_start_after": shown(rows[-1][0]) if more else None}


def _cut(rows: Iterator[tuple[bytes, list]], limit: int) -> Iterator[dict[str, Any]]:
    """Rows as pages; two pages are held at a time."""
    page = list(islice(rows, limit))
    while following := list(islice(rows, limit)):
        yield _page(page, True)
        page = following
    yield _page(page, False)


class Inspector:
    """Questions to a reader."""

    def __init__(self, reader: Reader, default_limit: int = DEFAULT_LIMIT, max_limit: int = MAX_LIMIT) -> None:
        self.reader, self.default_limit, self.max_limit, self.began = reader, default_limit, max_limit, time.monotonic()

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def meta(self) -> dict[str, Any]:
        g = self.reader.snapshot
        return {
            "mode": self.reader.mode, "configured_snapshot": self.reader.fixed, "snapshot": g.id, "total_buckets": g.total_buckets, "shards": len(g.shards),
            "default_limit": self.default_limit, "max_limit": self.max_limit, "uptime_ms": int(1000 * (time.monotonic() - self.began)),
        }

    def snapshots(self) -> list[dict[str, Any]]:
        current = self.reader.coordinator.current_id()
        return [{"id": g.id, "total_buckets": g.total_buckets, "shards": len(g.shards), "current": g.id == current} for g in self.reader.list_snapshots()]

    def scan(self, bucket: int, prefix: bytes = b"", start_after: bytes | None = None, limit: int | None = None, family: str = "default") -> dict[str, Any]:
        """A page of a bucket's rows by prefix; one row more is read to know whether there are more."""
        limit = self._limit(limit)
        rows = list(self._rows(bucket, prefix, start_after, ScanOptions(family=family, max_rows=limit + 1)))
        return _page(rows[:limit], len(rows) > limit)

    def pages(self, bucket: int, prefix: bytes = b"", start_after: bytes | None = None, limit: int | None = None, family: str = "default") -> Iterator[dict[str, Any]]:
        """All pages from a key on, one at least, as ``scan`` gives them one by one; but all are cut from one read of one snapshot."""
        limit = self._limit(limit)
        return _cut(self._rows(bucket, prefix, start_after, ScanOptions(family=family)), limit)

    def _limit(self, limit: int | None) -> int:
        limit = self.default_limit if limit is None else limit
        if not 1 <= limit <= self.max_limit:
            raise InvalidInput(f"a page holds 1 to {self.max_limit} rows")
        return limit

    def _rows(self, bucket: int, prefix: bytes, start_after: bytes | None, options: ScanOptions) -> Iterator[tuple[bytes, list]]:
        start = max(prefix, start_after + b"\0") if start_after is not None else prefix
        return self.reader.rows(bucket, start, successor(prefix), options)

    def lookup(self, keys: list[tuple[int, str]], encoding: str = "utf8", family: str = "default") -> list[dict[str, Any]]:
        """Rows by bucket and key, in the order asked for; those that are not there have no columns."""
        wanted = [(b, decoded_key(k, encoding)) for b, k in keys]
        found = self.reader.multi_get(wanted, ReadOptions(family=family))
        return [{"bucket": b, "key": shown(k), "columns": None if row is None else [shown(c) for c in row]} for (b, k), row in zip(wanted, found)]

    def set_mode(self, snapshot_id: int | None) -> str:
        """Reads one snapshot for good, or follows the current one."""
        before = self.reader.fixed
        self.reader.fixed = snapshot_id
        try:
            self.reader._load()
        except Exception:
            self.reader.fixed = before
            raise
        return self.reader.mode


def observed(view, name: str = "read"):
    """The view, counting its rows as it is read; and the observation that has the count afterwards."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return view.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def samples_frame(spark, samples: list[Sample]):
    """Metrics as a table; of a histogram its count, sum, least and most."""
    rows = []
    for s in samples:
        parts = s.value if isinstance(s.value, tuple) else (s.value,)
        names = ("count", "sum", "least", "most") if isinstance(s.value, tuple) else ("value",)
        rows += [(s.db_id, s.name, s.kind, n, float(v)) for n, v in zip(names, parts)]
    return spark.createDataFrame(rows, "db_id string, name string, kind string, part string, value double")
