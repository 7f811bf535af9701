"""Priority queues: a family of one column whose keys are taken in order above a cursor that only moves up."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidInput, InvalidState
from ..options import ReadOptions, ScanOptions, WriteOptions
from .resolve import CURSORS

if TYPE_CHECKING:
    from ..database import Database

KIND = {"kind": "priority_queue"}


def peek(view: DataFrame, cursors: DataFrame, k: int) -> DataFrame:
    """The k smallest keys above its cursor in each bucket; view: bucket, key, v; cursors: bucket, cursor."""
    above = view.join(cursors.select("bucket", "cursor"), "bucket", "left").where("cursor is null or key > cursor").drop("cursor")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
    return above.withColumn("place", place).where(F.col("place") <= k)


def advance(cursors: DataFrame, moves: DataFrame) -> DataFrame:
    """Cursors after moves (bucket, cursor); a move down changes nothing."""
    return cursors.select("bucket", "cursor").unionByName(moves.select("bucket", "cursor")).groupBy("bucket").agg(F.max("cursor").alias("cursor"))


def poll(view: DataFrame, cursors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """What peek gives, and the cursors moved to its last keys."""
    taken = peek(view, cursors, k)
    return taken, advance(cursors, taken.groupBy("bucket").agg(F.max("key").alias("cursor")))


class PriorityQueue:
    """A family of one column of a database: entries come out by key, above a stored cursor.

    An entry offered twice under one key is one entry whose values are joined; one offered at or
    below the cursor is never seen.
    """

    def __init__(self, db: Database, family: str) -> None:
        self.db, self.family = db, family

    def offer(self, bucket: int, key: bytes, value: bytes, ttl: int | None = None) -> None:
        self.db.merge(bucket, key, 0, value, WriteOptions(ttl, self.family))

    def delete(self, bucket: int, key: bytes) -> None:
        self.db.delete(bucket, key, 0, WriteOptions(family=self.family))

    def peek(self, bucket: int) -> tuple[bytes, bytes] | None:
        return next(iter(self.peek_batch(bucket, 1)), None)

    def peek_batch(self, bucket: int, n: int | None = None) -> list[tuple[bytes, bytes]]:
        """The n smallest entries (a block if no number is given)."""
        from ..database import BLOCK_ROWS

        n = BLOCK_ROWS if n is None else n
        if n < 0:
            raise InvalidInput("a number of entries is not negative")
        rows = self.db.view(ScanOptions(family=self.family, max_rows=n), bucket=bucket).orderBy("key").collect() if n else []
        return [(bytes(r.key), bytes(r.c0)) for r in rows]

    def poll(self, bucket: int) -> tuple[bytes, bytes] | None:
        return next(iter(self.poll_batch(bucket, 1)), None)

    def poll_batch(self, bucket: int, n: int | None = None) -> list[tuple[bytes, bytes]]:
        """What peek_batch gives; the cursor moves to the last of them."""
        taken = self.peek_batch(bucket, n)
        if taken:
            self.advance_to(bucket, taken[-1][0])
        return taken

    def advance_to(self, bucket: int, key: bytes) -> None:
        self.db.advance_truncation_cursor(bucket, self.family, key)

    def cursor(self, bucket: int) -> bytes | None:
        return self.db.truncation_cursor(bucket, self.family)

    def frame(self, k: int | None = None) -> DataFrame:
        """The entries of all buckets, or the k smallest of each, without moving a cursor."""
        return self.db.view(ScanOptions(family=self.family, max_rows=k) if k is not None else ReadOptions(family=self.family))

    def poll_frame(self, k: int) -> DataFrame:
        """The k smallest entries of each bucket; all cursors move to their last keys, in one new version."""
        db = self.db
        db.flush()
        taken = db.store.written(self.frame(k), "polled")
        moves = taken.groupBy("bucket").agg(F.max("key").alias("key"))
        rows = moves.select(
            F.lit(db.next_seq).cast("long").alias("seq"), "bucket", F.lit(CURSORS).alias("cf"), "key", F.lit(0).alias("col"), F.lit("put").alias("op"),
            F.lit(bytearray(self.family.encode())).alias("v"), F.lit(None).cast("long").alias("exp"), F.lit(0).alias("schema_v"),
        )
        db.next_seq = db.store.append(rows).last_seq + 1
        return taken


def new_queue(db: Database, name: str) -> PriorityQueue:
    if name == "default":
        raise InvalidInput("the default family is no queue")
    if name in db.current_schema().families:
        raise InvalidState(f"there is a family {name}")
    edit = db.edit_schema().ensure_family(name)
    db.commit(edit.add_column(0, family=name).set_family_options(name, metadata=KIND))
    return PriorityQueue(db, name)


def get_queue(db: Database, name: str) -> PriorityQueue:
    family = db.current_schema().families.get(name)
    if family is None or json.loads(family.metadata or "null") != KIND:
        raise InvalidInput(f"{name} is no queue")
    return PriorityQueue(db, name)


def get_or_new_queue(db: Database, name: str) -> PriorityQueue:
    return get_queue(db, name) if name in db.current_schema().families else new_queue(db, name)
