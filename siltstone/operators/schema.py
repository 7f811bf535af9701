"""Schemas by family and version, and the reading of rows written under older versions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput

MAX_FAMILIES = 230


@dataclass(frozen=True)
class Change:
    """add: a column at index, with a default for older rows; drop: the column at index."""

    kind: str
    index: int
    default: object = None


@dataclass(frozen=True)
class Family:
    width: int = 1
    operators: tuple[str, ...] = ("bytes",)
    value_has_ttl: bool = True
    metadata: str | None = None
    #: (version, changes made by it), oldest first.
    history: tuple[tuple[int, tuple[Change, ...]], ...] = ()
    #: JSON of each column: what its operator was made with, and what the caller noted.
    made_with: tuple[str | None, ...] = ()
    notes: tuple[str | None, ...] = ()
    id: int = 0

    def operator_metadata(self, index: int) -> dict:
        found = self.made_with[index] if index < len(self.made_with) else None
        return json.loads(found) if found else {}

    def column_metadata(self, index: int) -> Any:
        found = self.notes[index] if index < len(self.notes) else None
        return json.loads(found) if found else None


@dataclass(frozen=True)
class Schema:
    version: int = 0
    families: dict[str, Family] = field(default_factory=lambda: {"default": Family()})

    def edit(self) -> SchemaEdit:
        return SchemaEdit(self)

    def family(self, name: str) -> Family:
        if name not in self.families:
            raise InvalidInput(f"no column family {name}")
        return self.families[name]

    @property
    def family_ids(self) -> dict[str, int]:
        return {n: f.id for n, f in self.families.items()}

    def changes_after(self, family: str, written: int) -> list[Change]:
        return [c for version, changes in self.family(family).history if version > written for c in changes]

    def width_at(self, family: str, written: int) -> int:
        """How many columns the family had in an older version."""
        return self.family(family).width - sum(1 if c.kind == "add" else -1 for c in self.changes_after(family, written))

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=lambda b: {"hex": bytes(b).hex()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        d, families = json.loads(text), {}
        for name, f in d["families"].items():
            undo = lambda c: Change(c["kind"], c["index"], bytes.fromhex(c["default"]["hex"]) if isinstance(c["default"], dict) else c["default"])
            history = tuple((v, tuple(undo(c) for c in changes)) for v, changes in f["history"])
            families[name] = Family(**f | {"operators": tuple(f["operators"]), "history": history, "made_with": tuple(f["made_with"]), "notes": tuple(f["notes"])})
        return cls(d["version"], families)

    def read_as(self, family: str, written: int, columns: list[Column]) -> list[Column]:
        """Columns written under a version, as this version has them."""
        out = list(columns)
        for version, changes in self.family(family).history:
            if version > written:
                for c in changes:
                    if c.kind == "add":
                        out.insert(c.index, F.lit(c.default))
                    else:
                        out.pop(c.index)
        return out


def _padded(t: tuple, width: int) -> tuple:
    return (*t, *[None] * (width - len(t)))


def _inserted(t: tuple, index: int, x: object) -> tuple:
    return (*t[:index], x, *t[index:])


def _with(t: tuple, index: int, x: object) -> tuple:
    return (*t[:index], x, *t[index + 1 :])


class SchemaEdit:
    """Changes that become one new version by commit."""

    def __init__(self, base: Schema) -> None:
        self.base, self.families, self.changes = base, dict(base.families), {}

    def ensure_family(self, name: str, value_has_ttl: bool = True) -> SchemaEdit:
        if name not in self.families:
            if len(self.families) >= MAX_FAMILIES:
                raise InvalidInput("too many column families")
            self.families[name] = Family(0, (), value_has_ttl, id=1 + max((f.id for f in self.families.values()), default=-1))
        return self

    def set_family_options(self, family: str = "default", value_has_ttl: bool | None = None, metadata: Any = None) -> SchemaEdit:
        f = self.ensure_family(family).families[family]
        f = replace(f, value_has_ttl=f.value_has_ttl if value_has_ttl is None else value_has_ttl)
        self.families[family] = replace(f, metadata=json.dumps(metadata)) if metadata is not None else f
        return self

    def set_column_metadata(self, index: int, value: Any, family: str = "default") -> SchemaEdit:
        """What the caller notes on a column; none clears it."""
        f = self._column(index, family)
        self.families[family] = replace(f, notes=_with(_padded(f.notes, f.width), index, None if value is None else json.dumps(value)))
        return self

    def _column(self, index: int, family: str) -> Family:
        f = self.families[family] if family in self.families else self.base.family(family)
        if not 0 <= index < f.width:
            raise InvalidInput(f"no column {index} in {family}")
        return f

    def add_column(self, index: int, operator: str = "bytes", default: object = None, family: str = "default", **made_with: Any) -> SchemaEdit:
        self.ensure_family(family)
        f = self.families[family]
        if not 0 <= index <= f.width:
            raise InvalidInput(f"no place {index} in {family}")
        self._note(family, Change("add", index, default))
        made = json.dumps(made_with) if made_with else None
        self.families[family] = replace(
            f, width=f.width + 1, operators=_inserted(f.operators, index, operator),
            made_with=_inserted(_padded(f.made_with, f.width), index, made), notes=_inserted(_padded(f.notes, f.width), index, None),
        )
        return self

    def delete_column(self, index: int, family: str = "default") -> SchemaEdit:
        f = self._column(index, family)
        self._note(family, Change("drop", index))
        without = lambda t: (*t[:index], *t[index + 1 :])
        self.families[family] = replace(f, width=f.width - 1, operators=without(f.operators), made_with=without(_padded(f.made_with, f.width)), notes=without(_padded(f.notes, f.width)))
        return self

    def set_operator(self, index: int, operator: str, family: str = "default", **made_with: Any) -> SchemaEdit:
        """Binds an operator; the family widens to hold the column."""
        f = self.ensure_family(family).families[family]
        while f.width <= index:
            f = self.add_column(f.width, family=family).families[family]
        made = json.dumps(made_with) if made_with else None
        self.families[family] = replace(f, operators=_with(f.operators, index, operator), made_with=_with(_padded(f.made_with, f.width), index, made))
        return self

    def _note(self, family: str, change: Change) -> None:
        noted = self.changes.setdefault(family, [])
        if noted and noted[0].kind != change.kind:
            raise InvalidInput("a commit does not both add and drop columns of a family")
        noted.append(change)

    def commit(self, current: Schema | None = None) -> Schema:
        if current is not None and current.version != self.base.version:
            raise InvalidInput("the schema changed meanwhile")
        version = self.base.version + 1
        done = {n: replace(f, history=(*f.history, (version, tuple(self.changes[n])))) if n in self.changes else f for n, f in self.families.items()}
        return Schema(version, done)


def schema_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    """A row a column: its family's id and options, its operator with what that was made with, and its notes."""
    rows = [
        (name, f.id, f.value_has_ttl, f.metadata, i, f.operators[i], f.made_with[i] if i < len(f.made_with) else None, f.notes[i] if i < len(f.notes) else None)
        for name, f in schema.families.items() for i in range(f.width)
    ]
    return spark.createDataFrame(rows, "family string, id int, value_has_ttl boolean, family_metadata string, col int, operator string, made_with string, notes string")
