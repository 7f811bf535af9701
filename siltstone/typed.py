"""Databases, snapshots and scans whose columns are bytes or lists of bytes, checked and encoded on the way."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .coordinator import GlobalSnapshot, Reader
from .database import Database, Readable, ReadOnly, Snapshot
from .errors import InvalidInput
from .functions.merge import KEYS
from .operators.schema import Schema
from .operators.writes import WriteBatch
from .options import DEFAULT_READ, DEFAULT_SCAN, DEFAULT_WRITE, Config, ReadOptions, ScanOptions, WriteOptions
from .plans.scan import GlobalScanPlan, ShardSplit


@dataclass(frozen=True)
class ListType:
    """Lists of bytes; keep: the first or the last ``cap`` elements; element_ttl: each element has its own expiry."""

    cap: int | None = None
    keep: str = "first"
    element_ttl: bool = False

    def __post_init__(self) -> None:
        if self.keep not in ("first", "last") or (self.cap is not None and self.cap < 0):
            raise InvalidInput("a list keeps its first or last elements, 0 at least")

    def encode(self, elements: Iterable[bytes], expires: int | None = None) -> bytes:
        """A list as it is stored: a count, then of each element its expiry (0: none), if kept, its length and itself."""
        out, n = bytearray(), 0
        for e in elements:
            if not isinstance(e, bytes | bytearray):
                raise InvalidInput("an element of a list is bytes")
            out += (expires or 0).to_bytes(4, "little") if self.element_ttl else b""
            out += len(e).to_bytes(4, "little") + e
            n += 1
        return n.to_bytes(4, "little") + bytes(out)

    def check(self, payload: bytes) -> bytes:
        """An encoded list, if it is one."""
        head, at = 8 if self.element_ttl else 4, 4
        for _ in range(int.from_bytes(payload[:4], "little") if len(payload) >= 4 else 0):
            size = int.from_bytes(payload[at + head - 4 : at + head], "little")
            at += head + size
            if at > len(payload):
                break
        if len(payload) < 4 or at != len(payload):
            raise InvalidInput("not an encoded list")
        return payload


@dataclass(frozen=True)
class BytesType:
    pass


ColumnType = BytesType | ListType


@dataclass(frozen=True)
class TypedSchema:
    """The types of the columns of each family."""

    version: int
    families: dict[str, tuple[ColumnType, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, schema: Schema) -> TypedSchema:
        kind = lambda f, i: ListType(**f.operator_metadata(i)) if f.operators[i] == "list" else BytesType()
        return cls(schema.version, {n: tuple(kind(f, i) for i in range(f.width)) for n, f in schema.families.items()})

    def column(self, family: str, index: int) -> ColumnType:
        if family not in self.families:
            raise InvalidInput(f"no column family {family}")
        if not 0 <= index < len(self.families[family]):
            raise InvalidInput(f"no column {index} in {family}")
        return self.families[family][index]

    def encode(self, family: str, index: int, value: Any, expires: int | None) -> bytes:
        kind = self.column(family, index)
        if isinstance(kind, ListType):
            if isinstance(value, bytes | bytearray | str):
                raise InvalidInput(f"column {index} of {family} takes lists")
            return kind.encode(value, expires)
        if not isinstance(value, bytes | bytearray):
            raise InvalidInput(f"column {index} of {family} takes bytes")
        return bytes(value)


class TypedSchemaEdit:
    """Changes of a typed schema; the first that is wrong is raised by ``commit``."""

    def __init__(self, db: TypedDatabase) -> None:
        self.db, self.edit, self.wrong = db, db.raw.edit_schema(), None

    def _do(self, change) -> TypedSchemaEdit:
        if self.wrong is None:
            try:
                change(self.edit)
            except InvalidInput as e:
                self.wrong = e
        return self

    def add_bytes_column(self, index: int, family: str = "default", default: bytes | None = None) -> TypedSchemaEdit:
        return self._do(lambda e: e.add_column(index, "bytes", default, family))

    def add_list_column(self, index: int, kind: ListType, family: str = "default") -> TypedSchemaEdit:
        return self._do(lambda e: e.add_column(index, "list", None, family, cap=kind.cap, keep=kind.keep, element_ttl=kind.element_ttl))

    def delete_column(self, index: int, family: str = "default") -> TypedSchemaEdit:
        return self._do(lambda e: e.delete_column(index, family))

    def set_family_options(self, family: str = "default", value_has_ttl: bool | None = None, metadata: Any = None) -> TypedSchemaEdit:
        return self._do(lambda e: e.set_family_options(family, value_has_ttl, metadata))

    def commit(self) -> TypedSchema:
        if self.wrong is not None:
            raise self.wrong
        return TypedSchema.of(self.db.raw.commit(self.edit))


class TypedBatch:
    """A batch whose values are checked as they are added."""

    def __init__(self, schema: TypedSchema, batch: WriteBatch, config: Config, now: int) -> None:
        self.schema, self.batch, self.config, self.now = schema, batch, config, now

    def _add(self, op: str, bucket: int, key: bytes, col: int, value: Any, options: WriteOptions) -> TypedBatch:
        expires = None if options.ttl is None else self.now + options.ttl  # an element's own, whether rows expire or not
        getattr(self.batch, op)(bucket, key, col, self.schema.encode(options.family, col, value, expires), options.family, options.ttl)
        return self

    def put(self, bucket: int, key: bytes, col: int, value: Any, options: WriteOptions = DEFAULT_WRITE) -> TypedBatch:
        return self._add("put", bucket, key, col, value, options)

    def merge(self, bucket: int, key: bytes, col: int, value: Any, options: WriteOptions = DEFAULT_WRITE) -> TypedBatch:
        return self._add("merge", bucket, key, col, value, options)

    def delete(self, bucket: int, key: bytes, col: int, options: WriteOptions = DEFAULT_WRITE) -> TypedBatch:
        self.schema.column(options.family, col)
        self.batch.delete(bucket, key, col, options.family)
        return self


class TypedReads:
    """Reads of typed columns; an element of a list that expired is not in it."""

    raw: Readable

    def schema(self) -> TypedSchema:
        return TypedSchema.of(self.raw.current_schema())

    def view(self, options: ReadOptions = DEFAULT_READ, start: bytes | None = None, end: bytes | None = None, bucket: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """Resolved rows: KEYS, and c0, c1, ... as bytes or arrays of bytes."""
        return plain_lists(self.raw.view(replace(options, raw=False), start, end, bucket, wanted))

    def get(self, bucket: int, key: bytes, options: ReadOptions = DEFAULT_READ) -> list | None:
        row = self.view(options, key, key + b"\0", bucket).first()
        return None if row is None else typed_cells(row)

    def multi_get(self, keys: list[tuple[int, bytes]], options: ReadOptions = DEFAULT_READ) -> list[list | None]:
        return [None if r is None else [_without_expiry(x) for x in r] for r in self.raw.multi_get(keys, replace(options, raw=False))]

    def scan(self, bucket: int, start: bytes | None = None, end: bytes | None = None, options: ScanOptions = DEFAULT_SCAN) -> DataFrame:
        return self.view(options, start, end, bucket).orderBy("key")

    def rows(self, bucket: int, start: bytes | None = None, end: bytes | None = None, options: ScanOptions = DEFAULT_SCAN) -> Iterator[tuple[bytes, list]]:
        for r in self.scan(bucket, start, end, options).toLocalIterator():
            yield bytes(r.key), typed_cells(r)

    def get_raw(self, bucket: int, key: bytes, options: ReadOptions = DEFAULT_READ) -> list | None:
        """The columns as they would be stored."""
        return self.raw.get(bucket, key, replace(options, raw=True))

    def scan_raw(self, bucket: int, start: bytes | None = None, end: bytes | None = None, options: ScanOptions = DEFAULT_SCAN) -> DataFrame:
        return self.raw.scan(bucket, start, end, replace(options, raw=True))


def plain_lists(view: DataFrame) -> DataFrame:
    """Lists of elements with expiries as lists of elements."""
    lists = {f.name for f in view.schema.fields if isinstance(f.dataType, ArrayType)}
    return view.select(*[F.transform(n, lambda e: e["v"]).alias(n) if n in lists else F.col(n) for n in view.columns])


def _without_expiry(x: Any) -> Any:
    return [bytes(e["v"]) for e in x] if isinstance(x, list) else x


def typed_cells(row) -> list:
    out = [x for name, x in row.asDict().items() if name not in KEYS]
    return [[bytes(e) for e in x] if isinstance(x, list) else None if x is None else bytes(x) for x in out]


class TypedDatabase(TypedReads):
    """A database of typed columns. What it does not name itself (snapshots, rescaling, compaction, queues, clock,
    metrics, close) is the database's own."""

    def __init__(self, raw: Database) -> None:
        self.raw = raw

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None, **more) -> TypedDatabase:
        return cls(Database.open(spark, path, config, **more))

    @classmethod
    def resume(cls, spark: SparkSession, path: str, config: Config | None = None, **more) -> TypedDatabase:
        return cls(Database.resume(spark, path, config, **more))

    @classmethod
    def open_from_snapshot(cls, spark: SparkSession, path: str, snapshot_id: int, config: Config | None = None, **more) -> TypedDatabase:
        return cls(Database.open_from_snapshot(spark, path, snapshot_id, config, **more))

    @classmethod
    def branch(cls, spark: SparkSession, path: str, source: str, snapshot_id: int, config: Config | None = None, **more) -> TypedDatabase:
        return cls(Database.branch(spark, path, source, snapshot_id, config, **more))

    def __getattr__(self, name: str) -> Any:
        if name == "raw":
            raise AttributeError(name)
        return getattr(self.raw, name)

    def edit(self) -> TypedSchemaEdit:
        return TypedSchemaEdit(self)

    def apply_schema(self, wanted: TypedSchema) -> TypedSchema:
        """Adds the families and columns that are missing at the end; a column of another type is an error."""
        have, edit = self.schema(), self.edit()
        for family, kinds in wanted.families.items():
            own = have.families.get(family, ())
            if any(a != b for a, b in zip(own, kinds)) or len(own) > len(kinds):
                raise InvalidInput(f"{family} has other columns")
            for i in range(len(own), len(kinds)):
                edit = edit.add_list_column(i, kinds[i], family) if isinstance(kinds[i], ListType) else edit.add_bytes_column(i, family)
        return edit.commit()

    reload_schema = TypedReads.schema

    def new_batch(self) -> TypedBatch:
        return TypedBatch(self.schema(), self.raw.new_batch(), self.raw.config, self.raw.clock.now())

    def write(self, batch: TypedBatch, durable: bool = False) -> None:
        self.raw.write(batch.batch, durable)

    def put(self, bucket: int, key: bytes, col: int, value: Any, options: WriteOptions = DEFAULT_WRITE) -> None:
        self.write(self.new_batch().put(bucket, key, col, value, options), options.durable)

    def merge(self, bucket: int, key: bytes, col: int, value: Any, options: WriteOptions = DEFAULT_WRITE) -> None:
        self.write(self.new_batch().merge(bucket, key, col, value, options), options.durable)

    def delete(self, bucket: int, key: bytes, col: int, options: WriteOptions = DEFAULT_WRITE) -> None:
        self.write(self.new_batch().delete(bucket, key, col, options), options.durable)

    def put_bytes_batch(self, bucket: int, col: int, entries: Iterable[tuple[bytes, bytes]], options: WriteOptions = DEFAULT_WRITE) -> None:
        if not isinstance(self.schema().column(options.family, col), BytesType):
            raise InvalidInput(f"column {col} of {options.family} takes lists")
        self.raw.put_batch(bucket, col, entries, options)

    def _encoded(self, col: int, payload: bytes, options: WriteOptions) -> bytes:
        kind = self.schema().column(options.family, col)
        if not isinstance(kind, ListType):
            raise InvalidInput(f"column {col} of {options.family} takes bytes")
        return kind.check(payload)

    def put_encoded_list(self, bucket: int, key: bytes, col: int, payload: bytes, options: WriteOptions = DEFAULT_WRITE) -> None:
        self.raw.put(bucket, key, col, self._encoded(col, payload, options), options)

    def merge_encoded_list(self, bucket: int, key: bytes, col: int, payload: bytes, options: WriteOptions = DEFAULT_WRITE) -> None:
        self.raw.merge(bucket, key, col, self._encoded(col, payload, options), options)

    def at_snapshot(self, id: int) -> TypedReadOnly:
        return TypedReadOnly(self.raw.at_snapshot(id))


class TypedReadOnly(TypedReads):
    def __init__(self, raw: ReadOnly) -> None:
        self.raw = raw

    @property
    def snapshot(self) -> Snapshot:
        return self.raw.snapshot


class TypedReader:
    """Typed reads of a global snapshot."""

    def __init__(self, raw: Reader) -> None:
        self.raw = raw

    @property
    def snapshot(self) -> GlobalSnapshot:
        return self.raw.snapshot

    def shard(self, bucket: int) -> TypedReadOnly:
        return TypedReadOnly(self.raw.shard(bucket))

    def get(self, bucket: int, key: bytes, options: ReadOptions = DEFAULT_READ) -> list | None:
        return self.shard(bucket).get(bucket, key, options)

    def multi_get(self, keys: list[tuple[int, bytes]], options: ReadOptions = DEFAULT_READ) -> list[list | None]:
        return [None if r is None else [_without_expiry(x) for x in r] for r in self.raw.multi_get(keys, replace(options, raw=False))]

    def scan(self, bucket: int, start: bytes | None = None, end: bytes | None = None, options: ScanOptions = DEFAULT_SCAN) -> DataFrame:
        return self.shard(bucket).scan(bucket, start, end, options)

    def view(self, options: ReadOptions = DEFAULT_READ, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return plain_lists(self.raw.view(replace(options, raw=False), start, end))

    def refresh(self) -> None:
        self.raw.refresh()

    def list_snapshots(self) -> list[GlobalSnapshot]:
        return self.raw.list_snapshots()


@dataclass(frozen=True)
class TypedScanSplit(ShardSplit):
    """A split whose rows are typed; ``split_after`` and JSON as of any split."""

    def scanner(self, spark: SparkSession, config: Config | None = None, options: ScanOptions = DEFAULT_SCAN, **more) -> DataFrame:
        return plain_lists(super().scanner(spark, config, replace(options, raw=False), **more))


class TypedScanPlan(GlobalScanPlan):
    def splits(self) -> list[TypedScanSplit]:
        return [TypedScanSplit(s.path, s.id, s.ranges, self.start, self.end) for s in self.snapshot.shards]
