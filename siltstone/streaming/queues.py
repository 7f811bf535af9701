"""Streams and priority queues: offers that go to a stored queue, and a queue that is a stream's own state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.queue import PriorityQueue
from .ingest import ingest


def offers(spark: SparkSession, source: str, schema: str, queue: PriorityQueue, checkpoint: str, as_offers: Callable[[DataFrame], DataFrame], files_per_trigger: int = 8) -> None:
    """Offers all rows of a folder of files to a stored queue. as_offers: (seq, bucket, key, v) of the source's rows.

    A batch that is replayed is not offered twice; an offer at or below its bucket's cursor is never seen.
    """
    db = queue.db
    db.flush()
    base, schema_v = db.next_seq, db.current_schema().version

    def as_log(rows: DataFrame) -> DataFrame:
        return as_offers(rows).select(
            (F.col("seq") + base).alias("seq"), "bucket", F.lit(queue.family).alias("cf"), "key", F.lit(0).alias("col"), F.lit("merge").alias("op"), "v",
            F.lit(None).cast("long").alias("exp"), F.lit(schema_v).alias("schema_v"),
        )

    ingest(spark, source, schema, db.store, checkpoint, files_per_trigger, as_log, f"offers:{queue.family}")
    db.next_seq = db.manifest().last_seq + 1


POLLED = "bucket int, key binary, v binary, turn long"


class QueueState(StatefulProcessor):
    """A bucket's queue in the state store: entries by key, and the cursor that only moves up.

    Rows (seq, bucket, op, key, v, n) are taken in order of seq: offer joins v to the key's entry,
    delete drops it, advance moves the cursor to key, poll hands out the n smallest and moves on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key binary", "v binary")
        self.cursor = handle.getValueState("cursor", "key binary")

    def _advance(self, to: bytes) -> None:
        self.cursor.update((bytearray(to),))
        for (key,) in [k for k in self.entries.keys() if bytes(k[0]) <= to]:
            self.entries.removeKey((bytearray(key),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            cursor = bytes(self.cursor.get()[0]) if self.cursor.exists() else None
            if r.op == "poll":
                taken = sorted((bytes(k[0]), bytes(v[0])) for k, v in self.entries.iterator())[: int(r.n)]
                out += [(key[0], k, v, r.seq) for k, v in taken]
                if taken:
                    self._advance(taken[-1][0])
                continue
            own = bytes(r.key)
            if cursor is not None and own <= cursor:
                continue
            place = (bytearray(own),)
            if r.op == "offer":
                before = bytes(self.entries.getValue(place)[0]) if self.entries.containsKey(place) else b""
                self.entries.updateValue(place, (bytearray(before + bytes(r.v)),))
            elif r.op == "delete":
                self.entries.removeKey(place)
            elif r.op == "advance":
                self._advance(own)
        yield pd.DataFrame(out, columns=["bucket", "key", "v", "turn"])

    def close(self) -> None:
        pass


def polled(ops: DataFrame) -> DataFrame:
    """What the polls in a stream of queue operations hand out, a group a bucket; needs the RocksDB state store."""
    return ops.groupBy("bucket").transformWithStateInPandas(QueueState(), POLLED, "Append", "None")
