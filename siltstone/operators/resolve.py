"""Version resolution: from a log of mutations to rows at a snapshot.

A log has seq, bucket, cf, key, col, op (put, delete, merge), v and exp, a stored one also schema_v. Rules: expired versions
are dropped first (a delete never expires), then those at or below a cursor and beyond the
snapshot; of each column the versions from its last put or delete on count, oldest first; a row
all of whose selected columns are null is not there; its expiry is that of its newest version.

The last put or delete is found by an aggregate with map-side combine and joined back, not by a
window, so that a hot key is split by adaptive execution instead of sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.merge import KEYS, MergeOperator, Operators
from .schema import Schema

COLUMN = (*KEYS, "col")
#: The family whose rows are truncation cursors: v is the family that a key of it cuts off, up to itself.
CURSORS = "#cursor"


def visible(log: DataFrame, now: int | None = None, at: int | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """Versions not expired at ``now``, not after the snapshot's seq, and above the cursor of their bucket and family."""
    out = log
    if at is not None:
        out = out.where(F.col("seq") <= at)
    if now is not None and "exp" in log.columns:
        out = out.where((F.col("op") == "delete") | F.col("exp").isNull() | (F.col("exp") > now))
    if cursors is not None:
        out = out.join(cursors.select("bucket", "cf", "cursor"), ["bucket", "cf"], "left").where("cursor is null or key > cursor").drop("cursor")
    return out


def live(versions: DataFrame) -> DataFrame:
    """The versions of each column from its last put on, deletes gone."""
    floors = versions.where("op <> 'merge'").groupBy(*COLUMN).agg(F.max("seq").alias("floor"))
    return versions.join(floors, list(COLUMN), "left").where("op <> 'delete' and (floor is null or seq >= floor)").drop("floor")


def rows(log: DataFrame, columns: dict[str, tuple[int, MergeOperator, str]], now: int | None = None, at: int | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """Resolved rows: KEYS and one column each of name -> (column index, operator, value column of the log)."""
    wanted = sorted({i for i, _, _ in columns.values()})
    kept = live(visible(log, now, at, cursors).where(F.col("col").isin(wanted)))
    values = [op.value(F.when(F.col("col") == i, F.col(v)), F.col("seq")).alias(name) for name, (i, op, v) in columns.items()]
    found = kept.groupBy(*KEYS).agg(*values)
    return found.where(F.coalesce(*[F.col(n).cast("string") for n in columns]).isNotNull())


def evolved(log: DataFrame, schema: Schema, family: str) -> DataFrame:
    """The log of one family with the columns of the schema's present version.

    Columns move as later versions added or dropped others. A version of a key that was written
    before a column was added holds the column's default, as if it had been put with it.
    """
    moves, fills = [], []
    for written in range(schema.version):
        width, changes = schema.width_at(family, written), schema.changes_after(family, written)
        if not changes:
            continue
        places: list[int | None] = list(range(width))
        defaults: list[bytes | None] = [None] * width
        for c in changes:
            if c.kind == "add":
                places.insert(c.index, None)
                defaults.insert(c.index, c.default)
            else:
                places.pop(c.index)
                defaults.pop(c.index)
        moves += [(written, old, places.index(old) if old in places else None) for old in range(width)]
        fills += [(written, new, d) for new, d in enumerate(defaults) if d is not None]
    if not moves and not fills:
        return log
    old = F.col("schema_v")
    place = F.col("col")
    for written, was, new in moves:
        place = F.when((old == written) & (F.col("col") == was), F.lit(new).cast("int")).otherwise(place)
    far = F.col("far") if "far" in log.columns else F.lit(False)
    own = F.struct(place.alias("col"), F.col("op").alias("op"), F.col("v").alias("v"), far.alias("far"))
    filled = [F.when(old == written, F.struct(F.lit(new).alias("col"), F.lit("put").alias("op"), F.lit(bytearray(d)).alias("v"), F.lit(False).alias("far"))) for written, new, d in fills]
    rest = [c for c in log.columns if c not in ("col", "op", "v", "far")]
    many = log.select(*rest, F.explode(F.array(own, *filled)).alias("cell")).where("cell is not null and cell.col is not null")
    return many.select(*rest, "cell.*").select(*log.columns)


def stored_rows(
    log: DataFrame, schema: Schema, family: str, columns: list[int] | None = None, operators: Operators | None = None,
    now: int | None = None, at: int | None = None, cursors: DataFrame | None = None, raw: bool = True, fetch: Callable[[DataFrame], DataFrame] | None = None,
    clock: int | None = None,
) -> DataFrame:
    """Resolved rows of one family of a stored log: KEYS, c0, c1, ... in the order asked for; bytes if ``raw``, typed otherwise.

    fetch: brings values that lie beside the log; only the versions that count are asked for theirs.
    clock: the time by which operators go, such as lists whose elements expire even where rows do not; now if not given.
    """
    f, operators = schema.family(family), operators or Operators()
    wanted = list(range(f.width)) if columns is None else list(columns)
    if bad := [c for c in wanted if not 0 <= c < f.width]:
        raise InvalidInput(f"no column {bad[0]} in {family}")
    own = log.where(F.col("cf") == family)
    if not f.value_has_ttl:
        own = own.withColumn("exp", F.lit(None).cast("bigint"))
    kept = live(evolved(visible(own, now, at, cursors), schema, family).where(F.col("col").isin(wanted)))
    kept = kept if fetch is None else fetch(kept)
    found = {c: operators.resolve(f.operators[c], f.operator_metadata(c)).at(now if clock is None else clock) for c in wanted}
    values = [op.value(F.when(F.col("col") == c, op.typed(F.col("v"))), F.col("seq")).alias(f"c{i}") for i, (c, op) in enumerate((c, found[c]) for c in wanted)]
    rows_ = kept.groupBy(*KEYS).agg(*values)
    there = F.lit(False)
    for i in range(len(wanted)):
        there = there | F.col(f"c{i}").isNotNull()
    rows_ = rows_.where(there)
    if not raw:
        return rows_
    return rows_.select(*KEYS, *[found[c].stored(F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(wanted)])


def compacted(log: DataFrame, schema: Schema, operators: Operators, now: int | None = None, cursors: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """The same log in fewer versions: whatever is read from it, now or later, is the same.

    Gone are versions expired by now, at or below a cursor, or older than a lasting put or delete
    of their column. The versions from there to the first that expires are folded into one; those
    after it stay, as they may become visible again in part. Deletes go only where the log is whole:
    otherwise they hide what lies below. Schemas evolve on the way.
    """
    parts = [log.where(F.col("cf") == CURSORS)]
    for family, f in schema.families.items():
        own = log.where(F.col("cf") == family)
        if not f.value_has_ttl:
            own = own.withColumn("exp", F.lit(None).cast("bigint"))
        kept = evolved(visible(own, now, None, cursors), schema, family).withColumn("schema_v", F.lit(schema.version))
        floors = kept.where("op <> 'merge' and (exp is null or op = 'delete')").groupBy(*COLUMN).agg(F.max(F.struct("seq", "op")).alias("floor"))
        kept = kept.join(floors, list(COLUMN), "left").where("floor is null or seq >= floor.seq")
        bounds = kept.where("exp is not null").groupBy(*COLUMN).agg(F.min("seq").alias("first_expiring"))
        kept = kept.join(bounds, list(COLUMN), "left")
        folding = F.lit(False)
        for c in range(f.width):
            if operators.resolve(f.operators[c], f.operator_metadata(c)).foldable:
                folding = folding | (F.col("col") == c)
        early = folding & (F.col("first_expiring").isNull() | (F.col("seq") < F.col("first_expiring")))
        stay = kept.where(~early).select(*log.columns)
        run = kept.where(early)
        values = []
        for c in range(f.width):
            op = operators.resolve(f.operators[c], f.operator_metadata(c))
            if op.foldable:
                cell = op.value(F.when((F.col("col") == c) & (F.col("op") != "delete"), op.typed(F.col("v"))), F.col("seq"))
                values.append((c, op, cell))
        if values:
            folded_ = run.groupBy(*COLUMN).agg(F.max("seq").alias("seq"), F.first("floor", True).alias("floor"), *[v.alias(f"x{c}") for c, _, v in values])
            v = F.coalesce(*[F.when(F.col("col") == c, op.stored(F.col(f"x{c}"))) for c, op, _ in values])
            op = F.when(F.col("floor").isNull(), "merge").when(v.isNull(), "delete").otherwise("put")
            stay = stay.unionByName(folded_.select("seq", *KEYS, "col", op.alias("op"), v.alias("v"), F.lit(None).cast("bigint").alias("exp"), F.lit(schema.version).alias("schema_v")))
        parts.append(stay.where("not (op = 'merge' and v is null)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if whole:
        # a delete that nothing of its column precedes hides nothing
        first = out.where(F.col("cf") != CURSORS).groupBy(*COLUMN).agg(F.min("seq").alias("first"))
        out = out.join(first, list(COLUMN), "left").where("not (op = 'delete' and seq = first)").drop("first").select(*log.columns)
    return out


def dead_parts(stats: DataFrame, now: int | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """stats (part, bucket, cf, rows, lasting, last_exp, hi) with whether each part is wholly expired or wholly at or
    below its cursor, so that it can go unread. lasting: rows that never expire."""
    late = F.lit(False) if now is None else (F.col("lasting") == 0) & (F.col("last_exp") <= now)
    if cursors is None:
        return stats.withColumn("expired", F.coalesce(late, F.lit(False))).withColumn("truncated", F.lit(False))
    held = stats.join(cursors.select("bucket", "cf", "cursor"), ["bucket", "cf"], "left")
    return held.withColumn("expired", F.coalesce(late, F.lit(False))).withColumn("truncated", F.coalesce(F.col("hi") <= F.col("cursor"), F.lit(False))).drop("cursor")


def expiry(log: DataFrame, now: int) -> DataFrame:
    """The expiry of each row: that of its newest version that is not expired."""
    return live(visible(log, now)).groupBy(*KEYS).agg(F.max_by("exp", "seq").alias("exp"))


def fold_batches(log: DataFrame, size: int) -> DataFrame:
    """The log with each run of ``size`` seqs folded per column, for summed values.

    A fold keeps a put or delete if the batch holds one; a chain of merges alone stays a merge, so
    that folding again, with older versions, gives what the whole log gives.
    """
    batch = F.floor(F.col("seq") / size).cast("long")
    dealt = log.withColumn("batch", batch)
    group = [*COLUMN, "batch"]
    last = dealt.where("op <> 'merge'").groupBy(*group).agg(F.max(F.struct("seq", "op")).alias("last"))
    kept = dealt.join(last, group, "left").where("last is null or seq >= last.seq")
    folded = kept.groupBy(*group).agg(F.max("seq").alias("seq"), F.first("last", True).alias("last"), F.sum(F.when(F.col("op") != "delete", F.col("v"))).alias("v"), F.max(F.when(F.col("op") == "merge", 1)).alias("merged"))
    # a delete with merges after it starts from nothing: a put of what was merged
    op = F.when(F.col("last").isNull(), "merge").when((F.col("last.op") == "delete") & F.col("merged").isNull(), "delete").otherwise("put")
    return folded.select("seq", *COLUMN, op.alias("op"), "v")
