"""Options of a database, its reads and writes, and their files."""

from __future__ import annotations

import configparser
import json
import time
import tomllib
from dataclasses import asdict, dataclass, fields
from typing import Any

from .errors import InvalidInput

# The uses that a volume may serve.
VOLUME_KINDS = ("meta", "primary_data_priority_high", "primary_data_priority_medium", "primary_data_priority_low", "snapshot", "cache", "readonly", "wal")


class SystemClock:
    """Seconds of the epoch."""

    def now(self) -> int:
        return int(time.time())


class ManualClock:
    """Starts at 0 and only moves forward."""

    def __init__(self, start: int = 0) -> None:
        self.time = start

    def set(self, to: int) -> int:
        self.time = max(self.time, to)
        return self.time

    def now(self) -> int:
        return self.time


@dataclass(frozen=True)
class Volume:
    """A place for files and what it is for."""

    base_dir: str
    kinds: tuple[str, ...] = ("meta", "primary_data_priority_high", "snapshot", "wal")
    size_limit: int | None = None

    def __post_init__(self) -> None:
        if bad := [k for k in self.kinds if k not in VOLUME_KINDS]:
            raise InvalidInput(f"no volume kind {bad[0]}")


@dataclass(frozen=True)
class Config:
    """What a database is opened with.

    file_systems: (scheme, Hadoop class) of stores that the session does not know. stall_deltas: segments behind the
    base beyond which a write folds them first. value_log_threshold: values of more bytes lie beside the log.
    """

    volumes: tuple[Volume, ...] = ()
    num_columns: int = 1
    total_buckets: int = 65536
    ttl_enabled: bool = False
    default_ttl_seconds: int | None = None
    clock: str = "system"
    snapshot_retention: int | None = None
    data_file_type: str = "parquet"
    file_systems: tuple[tuple[str, str], ...] = ()
    compression: str = "zstd"
    bloom_keys: int = 0
    buffer_rows: int = 10_000
    max_deltas: int = 8
    stall_deltas: int | None = None
    compaction_policy: str = "score"
    value_log_threshold: int | None = None
    reload_tolerance_seconds: int = 10

    def __post_init__(self) -> None:
        if not 1 <= self.total_buckets <= 1 << 16:
            raise InvalidInput(f"{self.total_buckets} buckets")
        if self.num_columns < 1 or self.buffer_rows < 1 or self.max_deltas < 1:
            raise InvalidInput("columns, buffered rows and deltas are 1 at least")
        if self.clock not in ("system", "manual"):
            raise InvalidInput(f"no clock {self.clock}")
        if self.data_file_type not in ("parquet", "orc"):
            raise InvalidInput(f"files of type {self.data_file_type} are not written; parquet and orc are")
        if self.stall_deltas is not None and self.stall_deltas < self.max_deltas:
            raise InvalidInput("writes wait only beyond the segments that compaction waits for")
        if self.snapshot_retention is not None and self.snapshot_retention < 1:
            raise InvalidInput("retention keeps a snapshot at least")

    def place(self, kind: str, default: str) -> str:
        """The folder of the first volume of a kind; where no volume is named for it, the default."""
        if kind not in VOLUME_KINDS:
            raise InvalidInput(f"no volume kind {kind}")
        return next((v.base_dir.rstrip("/") for v in self.volumes if kind in v.kinds), default)

    def new_clock(self) -> SystemClock | ManualClock:
        return ManualClock() if self.clock == "manual" else SystemClock()

    def expiry(self, now: int, ttl: int | None) -> int | None:
        """When a write of now expires."""
        ttl = self.default_ttl_seconds if ttl is None else ttl
        return now + ttl if self.ttl_enabled and ttl is not None else None

    def to_json(self) -> str:
        """Options alone; credentials that a volume's address may hold stay out."""
        clean = lambda u: u.split("://")[0] + "://" + u.split("://")[1].split("@")[-1] if "://" in u and "@" in u else u
        return json.dumps(asdict(self) | {"volumes": [asdict(v) | {"base_dir": clean(v.base_dir)} for v in self.volumes]}, sort_keys=True)

    @classmethod
    def of(cls, values: dict[str, Any]) -> tuple[Config, list[str]]:
        """A config of named values, and the names that mean nothing."""
        known = {f.name: f for f in fields(cls)}
        unknown = sorted(k for k in values if k not in known)
        own = {k: v for k, v in values.items() if k in known}
        if "volumes" in own:
            made = []
            for v in own["volumes"]:
                kinds = v.get("kinds", Volume.__dataclass_fields__["kinds"].default)
                kinds = kinds.split(",") if isinstance(kinds, str) else kinds
                made.append(Volume(v["base_dir"], tuple(k.strip().lower().replace("-", "_") for k in kinds), v.get("size_limit")))
            own["volumes"] = tuple(made)
        if "file_systems" in own:
            own["file_systems"] = tuple(sorted((str(k), str(v)) for k, v in dict(own["file_systems"]).items()))
        return cls(**own), unknown

    @classmethod
    def load(cls, path: str) -> tuple[Config, list[str]]:
        """From a JSON, TOML, INI or YAML file by its extension, and the names in it that mean nothing."""
        kind = path.rsplit(".", 1)[-1].lower()
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if kind == "json":
            return cls.of(json.loads(text))
        if kind == "toml":
            return cls.of(tomllib.loads(text))
        if kind == "ini":
            parser = configparser.ConfigParser()
            parser.read_string(text if text.lstrip().startswith("[") else "[options]\n" + text)
            return cls.of({k: _plain(v) for s in parser.sections() for k, v in parser[s].items()})
        if kind in ("yaml", "yml"):
            try:
                import yaml
            except ImportError as e:
                raise InvalidInput("reading YAML needs the yaml library") from e
            return cls.of(yaml.safe_load(text) or {})
        raise InvalidInput(f"no reader for .{kind}")


def _plain(text: str) -> Any:
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "none", "null"):
        return None
    return int(low) if low.lstrip("-").isdigit() else text.strip()


@dataclass(frozen=True)
class ReadOptions:
    """columns: positions in the order wanted, all if none."""

    columns: tuple[int, ...] | None = None
    family: str = "default"
    raw: bool = True

    @classmethod
    def of(cls, *columns: int, family: str = "default") -> ReadOptions:
        return cls(columns or None, family)


@dataclass(frozen=True)
class ScanOptions(ReadOptions):
    max_rows: int | None = None

    def __post_init__(self) -> None:
        if self.max_rows is not None and self.max_rows < 1:
            raise InvalidInput("a limit is at least 1")


@dataclass(frozen=True)
class WriteOptions:
    """durable: stored before the call returns, not only buffered."""

    ttl: int | None = None
    family: str = "default"
    durable: bool = False


DEFAULT_READ, DEFAULT_SCAN, DEFAULT_WRITE = ReadOptions(), ScanOptions(), WriteOptions()
