"""Merge operators: how the live versions of one column become its value.

An operator is an aggregate over rows (seq, v) that are already resolved: the last put, if any,
and the merges after it. Operators with partial results (sums, capped lists) are combined on the
map side or over salts, so that a key with a large share of all rows does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .codec import from_little_endian, list_elements, list_payload, little_endian

KEYS = ("bucket", "cf", "key")


@dataclass(frozen=True)
class MergeOperator:
    """What one column's versions become. Values may be typed columns or, in a stored log, bytes."""

    name: str

    def value(self, v: Column, seq: Column) -> Column:
        """The aggregate over one column's live versions; null versions are not there."""
        raise NotImplementedError

    def typed(self, stored: Column) -> Column:
        """A stored cell as what ``value`` takes."""
        return stored

    def stored(self, value: Column) -> Column:
        """What ``value`` gives as a stored cell."""
        return value

    def at(self, now: int | None) -> MergeOperator:
        """The operator at a time, for those that look at the clock."""
        return self

    @property
    def foldable(self) -> bool:
        """Whether neighbouring versions may be combined for good, whatever comes later."""
        return True


def ordered(v: Column, seq: Column) -> Column:
    """Versions in order of seq, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(seq.alias("seq"), v.alias("v"))))), lambda s: s["v"])


@dataclass(frozen=True)
class Latest(MergeOperator):
    """Puts and deletes alone: the newest version."""

    name: str = "latest"

    def value(self, v: Column, seq: Column) -> Column:
        return F.max_by(v, F.when(v.isNotNull(), seq))


@dataclass(frozen=True)
class Concat(MergeOperator):
    """Bytes, or strings if ``text``, joined in order of seq."""

    name: str = "bytes"
    text: bool = False

    def value(self, v: Column, seq: Column) -> Column:
        parts = ordered(v, seq)
        joined = F.array_join(parts, "") if self.text else F.unhex(F.array_join(F.transform(parts, F.hex), ""))
        return F.when(F.size(parts) > 0, joined)


@dataclass(frozen=True)
class Counter(MergeOperator):
    """Unsigned sum of 32 or 64 bits; leaving the range is an error."""

    name: str = "u64_counter"
    bits: int = 64

    def value(self, v: Column, seq: Column) -> Column:
        total = F.sum(v.cast("decimal(20,0)")).cast("decimal(38,0)")
        most = F.lit(str(2**self.bits - 1)).cast("decimal(38,0)")
        bad = (total > most) | (total < 0)
        return F.when(bad, F.raise_error(F.lit(f"{self.name} overflow")).cast("decimal(38,0)")).otherwise(total)

    def typed(self, stored: Column) -> Column:
        return from_little_endian(stored, self.bits // 8, self.name)

    def stored(self, value: Column) -> Column:
        return little_endian(value, self.bits // 8)


@dataclass(frozen=True)
class ListAppend(MergeOperator):
    """Elements in order; keep: all, the first or the last ``cap``; elements whose expiry is at or before now are gone before the cap."""

    name: str = "list"
    cap: int | None = None
    keep: str = "first"

    def value(self, v: Column, seq: Column) -> Column:
        return self.capped(ordered(v, seq))

    def capped(self, a: Column) -> Column:
        if self.cap is None:
            return a
        n = F.least(F.lit(self.cap), F.size(a))
        taken = F.slice(a, 1, n) if self.keep == "first" else F.slice(a, F.size(a) - n + 1, n)
        return F.when(n == 0, F.slice(a, 1, 0)).otherwise(taken)


@dataclass(frozen=True)
class StoredList(MergeOperator):
    """Lists of bytes, each operand a list: all elements in order, or the first or last ``cap`` of those alive.

    With ``element_ttl`` an element carries its own expiry and is gone from then on, before the cap.
    """

    name: str = "list"
    cap: int | None = None
    keep: str = "first"
    element_ttl: bool = False
    now: int | None = None

    def value(self, v: Column, seq: Column) -> Column:
        parts = ordered(v, seq)
        all_ = F.flatten(parts)
        if self.element_ttl and self.now is not None:
            all_ = F.filter(all_, lambda e: e["exp"].isNull() | (e["exp"] > self.now))
        return F.when(F.size(parts) > 0, ListAppend(cap=self.cap, keep=self.keep).capped(all_))

    def typed(self, stored: Column) -> Column:
        return list_elements(stored, self.element_ttl)

    def stored(self, value: Column) -> Column:
        return list_payload(value, self.element_ttl)

    def at(self, now: int | None) -> MergeOperator:
        return replace(self, now=now)

    @property
    def foldable(self) -> bool:
        return not (self.element_ttl and self.cap is not None)  # an element that dies later makes room for another


Fold = Callable[[bytes, bytes, int | None], "bytes | tuple[bytes, str]"]


@dataclass(frozen=True)
class Custom(MergeOperator):
    """An operator of the caller's: merge(existing, operand, now) gives the new value, or it and put or delete,
    which ends what came before. Versions of a column are folded oldest first, in Arrow batches of columns."""

    name: str = "custom"
    merge: Fold | None = None
    now: int | None = None

    def value(self, v: Column, seq: Column) -> Column:
        merge, now = self.merge, self.now

        def fold(parts: pd.Series) -> pd.Series:
            return pd.Series([folded(merge, p, now) for p in parts], dtype=object)

        return F.pandas_udf(fold, "binary")(ordered(v, seq))

    def at(self, now: int | None) -> MergeOperator:
        return replace(self, now=now)

    @property
    def foldable(self) -> bool:
        return False


def folded(merge: Fold, parts: Iterable[bytes], now: int | None) -> bytes | None:
    """One column's versions through a caller's merge."""
    state: bytes | None = None
    for part in parts:
        found = merge(state or b"", bytes(part), now)
        state, kind = found if isinstance(found, tuple) else (found, "put")
        if kind not in ("put", "delete"):
            raise InvalidInput(f"an operator may make a put or a delete, not {kind}")
        if kind == "delete":
            state = None
    return state


class Operators:
    """Operators by id: the built-in ones and the caller's."""

    def __init__(self, **own: Callable[[dict], MergeOperator]) -> None:
        self.known: dict[str, Callable[[dict], MergeOperator]] = {
            "latest": lambda m: Latest(), "bytes": lambda m: Concat(), "u32_counter": lambda m: Counter("u32_counter", 32), "u64_counter": lambda m: Counter(),
            "list": lambda m: StoredList(cap=m.get("cap"), keep=m.get("keep", "first"), element_ttl=m.get("element_ttl", False)),
        }
        for name, make in own.items():
            self.register(name, make)

    def register(self, name: str, make: Callable[[dict], MergeOperator] | Fold) -> Operators:
        if name in self.known:
            raise InvalidInput(f"there is an operator {name}")
        self.known[name] = make
        return self

    def register_merge(self, name: str, merge: Fold) -> Operators:
        return self.register(name, lambda m: Custom(name, merge))

    def resolve(self, name: str, metadata: dict | None = None) -> MergeOperator:
        if name not in self.known:
            raise InvalidInput(f"unknown merge operator {name}")
        return self.known[name](metadata or {})


def operator(name: str, metadata: dict | None = None) -> MergeOperator:
    """The built-in operator with this id."""
    return Operators().resolve(name, metadata)


def capped_lists(live: DataFrame, op: ListAppend, salts: int = 32, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A capped list of each key by salts of neighbouring seqs: no task holds more than cap x salts elements of a key."""
    entry = F.array_sort(F.collect_list(F.struct("seq", "v")))
    part = live.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salts))).groupBy(*keys, "salt").agg(op.capped(entry).alias("part"))
    merged = part.groupBy(*keys).agg(op.capped(F.array_sort(F.flatten(F.collect_list("part")))).alias("part"))
    return merged.select(*keys, F.transform("part", lambda s: s["v"]).alias("v"))
