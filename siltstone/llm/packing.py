"""Hierarchical residual packing of documents into sequences of a fixed number of tokens.

1. Documents become pieces: ids and the end id, cut into full pieces only where longer than a
   sequence (the remainder comes first).
2. Leaves: pieces are dealt to nodes of about ``node_pieces`` by a hash and packed best-fit
   decreasing; sequences filled to ``full`` of the length are emitted.
3. Tree: underfull sequences of ``fan_in`` nodes meet, whole, as items of another best-fit round,
   until one node is left. After best-fit any two sequences of a node are more than a sequence long
   together, so that at most one a leaf is at most half full, and only such a one can still be
   joined to another. As many partners as there are leaves are enough for all of them, and the
   emptiest will do: a node hands on so many (``carry``, if that is more), and no union of two
   sequences is lost by emitting the rest. No piece is lost at any step.

Defined cases: a null text is the empty text and yields one piece with the end id alone; an empty
table gives an empty result; rows that repeat a doc_id are packed each; equal lengths are ordered
by doc_id and piece; very long texts become many pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hold_memory, id_text, prepare, shuffle_partitions
from .word_tokens import word_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A sequence's number: its level, node and place in the node, each in bits of its own (64 levels, 2^33 nodes, 2^24 places).
LEVEL_AT, NODE_AT = 57, 24
PACKED = PIECES + ", bin long, offset long, done boolean"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    prepare(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer, end_id)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist())):
                ids = np.frombuffer(data, f"<u{tokens.width}").astype("<u4")
                at, size = 0, len(ids) % length or length
                for piece in range(-(-len(ids) // length)):
                    rows.append((doc_id, piece, at, size, zlib.crc32(ids[at : at + size])))
                    at, size = at + size, length
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(cut_up, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item and its place there. sizes must be in falling order."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # those that some bin has, in order
    where, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    bins = 0
    for i, size in enumerate(sizes.tolist()):
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i], place[i] = b, capacity - room
        if left := room - size:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return where, place


def pack_node(rows: pd.DataFrame, level: int, node: int, capacity: int, full: float, carry: int) -> pd.DataFrame:
    """One best-fit round: rows of one bin move together."""
    rows = rows.sort_values(["bin", "offset", "doc_id", "piece"], kind="stable", ignore_index=True)
    items = rows.groupby("bin", sort=True)["length"].sum()
    order = np.argsort(-items.to_numpy(), kind="stable")
    where, place = best_fit(items.to_numpy()[order], capacity)
    item = np.repeat(np.arange(len(items)), rows.groupby("bin", sort=True).size())
    new_bin, shift = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
    new_bin[order], shift[order] = where, place
    bins, rows["offset"] = new_bin[item], rows["offset"] + shift[item]
    filled = np.bincount(bins, rows["length"], minlength=1).astype(np.int64)
    done = filled >= full * capacity
    if (emptiest := np.argsort(filled, kind="stable")[carry:]).size:
        done[emptiest] = True
    rows["bin"], rows["done"] = (np.int64(level) << LEVEL_AT) + (np.int64(node) << NODE_AT) + bins, done[bins]
    return rows


def _packer(columns: list[str], level: int, length: int, full: float, carry: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hold_memory("packing")
        return pack_node(rows[columns], level, key[0], length, full, carry)

    return pack


def best_fit_packing(
    docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048,
    node_pieces: int = 50_000, fan_in: int = 8, full: float = 0.999, carry: int = 20_000,
) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = cut(pieces(docs, tokenizer, end_id, length), "pieces")
    n = found.count()
    nodes = leaves = max(1, -(-n // node_pieces))
    columns = [c.split()[0] for c in PACKED.split(", ")]
    # each piece is an item of its own; its number only has to differ within its node
    first = found.select("*", F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("bigint").alias("offset"), F.lit(False).alias("done"))
    first = first.withColumn("node", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(nodes)))
    emitted, level, open_rows = [], 0, first
    while True:
        last = nodes == 1
        pack = _packer(columns, level, length, full, 0 if last else max(carry, leaves))
        spread = open_rows.repartition(max(1, min(nodes, shuffle_partitions(docs.sparkSession))), "node")
        packed = cut(spread.groupBy("node").applyInPandas(pack, PACKED), f"packed{level}")
        emitted.append(packed.where("done"))
        if last:
            break
        nodes, level = -(-nodes // fan_in), level + 1
        open_rows = packed.where("not done").withColumn("node", F.pmod(F.shiftright("bin", NODE_AT), F.lit(nodes)))
    out = emitted[0]
    for more in emitted[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
