"""Removal of repeated byte strings by suffix sorting of shards.

Each text is cut where it can be split without parting equal strings: a ``length``-byte string
belongs to the least hash of the 64-byte substrings in it, and neighbouring strings of one hash
form a stretch. Equal strings have equal hashes, so that a stretch can only repeat another of its
hash, or itself where its least hash occurs in it twice. Other hashes hold no repeat; equal stretches (by a 128-bit digest) repeat as a
whole and one of them stands for all. What remains, different stretches of one hash, is dealt to
shards by the hash, and each shard is sorted by external induced sorting with common prefixes:
strings whose neighbour shares ``length`` bytes are repeats.

A hash with more bytes than half a shard is parted further: its different stretches are cut anew by
the least hash of longer substrings, up to whole strings, until each fits. Strings that differ from
all others near the common substring fall out at each step; a whole string has one stretch at most
a length of its run, so that the last step always fits. Queues hold ``memory`` entries and go to disk beyond.

Defined cases: a null text is the empty text; texts under ``length`` bytes keep all; equal texts
count as occurrences of each other, also under one doc_id; overlapping repeats count; an empty
table gives an empty result; very long texts are many stretches; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_bytes, prepare
from .induced_sort import sorted_suffixes

ANCHOR = 64
#: Strings in a stretch at most (long runs of one hash are parted), bytes of a shard, entries of a queue in memory.
STRETCH, SHARD_BYTES, MEMORY = 512, 4 << 20, 1 << 21
#: Bytes of a passage's fingerprint, and those from which one is chosen.
PRINT, WINDOW = 160, 300
LISTS = "keys array<long>, firsts array<int>, counts array<int>, inners array<boolean>, digests array<binary>"
FOUND = f"doc_id long, sha string, n_bytes long, {LISTS}, prints array<long>"
ANEW = f"pkey long, pdigest binary, sha string, pat int, {LISTS}"
_SYMBOL = np.random.default_rng(400).integers(0, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SYMBOL[data] * _powers(_BASE, len(data)), dtype=np.uint64)))


def substring_hashes(sums: np.ndarray, anchor: int) -> np.ndarray:
    """Hashes of all substrings of ``anchor`` bytes."""
    h = (sums[anchor:] - sums[:-anchor]) * _powers(_BACK, len(sums) - anchor)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def passage_prints(sums: np.ndarray) -> np.ndarray:
    """Distinct fingerprints of PRINT bytes each, one from about every half WINDOW bytes, chosen by the least hash in each
    WINDOW bytes, so that two texts with a passage in common that is somewhat longer choose the same ones in it."""
    n = len(sums) - 1
    if n < PRINT:
        return np.empty(0, np.uint64)
    h = substring_hashes(sums, ANCHOR)
    low = np.uint64((1 << 24) - 1)
    placed = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)  # the least tells its place, in texts of 16 MiB; beyond, texts are cut there
    at = np.concatenate([first + _chosen(placed[first : first + (1 << 24)], min(WINDOW, n) - ANCHOR + 1) for first in range(0, len(placed), 1 << 24)])
    at = at[at + PRINT <= n]
    return np.unique((sums[at + PRINT] - sums[at]) * _powers(_BACK, n + 1)[at])


def _chosen(placed: np.ndarray, w: int) -> np.ndarray:
    least = sliding_least(placed, min(w, len(placed)))
    return (least[np.concatenate(([True], least[1:] != least[:-1]))] & np.uint64((1 << 24) - 1)).astype(np.int64)


def stretches(data: np.ndarray, length: int, anchor: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """(hash, first string, number of strings, whether the hash is in it twice) of each stretch of one text."""
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), []
    h = substring_hashes(prefix_sums(data) if sums is None else sums, anchor)
    least = sliding_least(h, length - anchor + 1)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    counts = np.diff(np.concatenate((starts, [len(least)])))
    if counts.max() > STRETCH:
        parts = -(-counts // STRETCH)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + at * STRETCH
        counts = np.diff(np.concatenate((starts, [len(least)])))
    keys, reach = least[starts], length - anchor
    inner = [np.count_nonzero(h[a:b] == k) > 1 for k, a, b in zip(keys, starts.tolist(), (starts + counts + reach).tolist())]
    return keys, starts, counts, inner


def anchors(length: int) -> list[int]:
    """Lengths of the substrings whose least hash keys a string, the first for all and the others for hot keys."""
    return sorted({min(ANCHOR, max(1, length // 4)), length // 2 or 1, length * 4 // 5 or 1, length * 19 // 20 or 1, length})


def stretch_lists(texts: list[bytes], length: int, anchor: int, prints: list[np.ndarray] | None = None) -> dict[str, pa.Array]:
    """The stretches of each text as the columns of LISTS; prints: takes the fingerprints of each text."""
    keys, firsts, counts, inners, digests = [], [], [], [], []
    for raw in texts:
        sums = prefix_sums(np.frombuffer(raw, np.uint8))
        k, f, c, i = stretches(np.frombuffer(raw, np.uint8), length, anchor, sums)
        if prints is not None:
            prints.append(passage_prints(sums).view(np.int64))
        keys.append(k.view(np.int64))
        firsts.append(f.astype(np.int32))
        counts.append(c.astype(np.int32))
        inners.append(i)
        digests.append([hashlib.blake2b(raw[a : a + n + length - 1], digest_size=16).digest() for a, n in zip(f.tolist(), c.tolist())])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return {name: pa.array(x, pa.list_(kind)) for name, x, kind in zip(("keys", "firsts", "counts", "inners", "digests"), (keys, firsts, counts, inners, digests), kinds)}


def find_stretches(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            shas = pa.array([hashlib.sha256(raw).hexdigest() for raw in texts], pa.string())
            prints: list[np.ndarray] = []
            lists = stretch_lists(texts, length, anchor, prints)
            sizes = pa.array([len(raw) for raw in texts], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "sha": shas, "n_bytes": sizes, **lists, "prints": pa.array(prints, pa.list_(pa.int64()))})

    return id_bytes(docs).mapInArrow(look, FOUND)


def flat_stretches(rows: DataFrame, *carried: str) -> DataFrame:
    zipped = rows.select(*carried, F.explode(F.arrays_zip("keys", "firsts", "counts", "inners", "digests")).alias("s"))
    return zipped.select(*carried, F.col("s.keys").alias("key"), F.col("s.firsts").alias("at"), F.col("s.counts").alias("n"), F.col("s.inners").alias("inner"), F.col("s.digests").alias("digest"))


def of_repeated_keys(flat: DataFrame) -> DataFrame:
    twice = flat.groupBy("key").agg(F.count("*").alias("m"), F.max("inner").alias("inner")).where("m > 1 or inner").select("key")
    return flat.join(twice, "key")


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of maximal runs of rising whole numbers."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > 1) + 1
    starts, ends = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(places)])) - 1
    return list(zip(places[starts].tolist(), places[ends].tolist()))


def repeats_in_shard(texts: list[bytes], length: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, string number) of each repeat in one shard."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.zeros(int(begins[-1]), np.uint16)  # 0 parts the texts
    for t, a in zip(texts, begins.tolist()):
        text[a : a + len(t)] = np.frombuffer(t, np.uint8).astype(np.uint16) + 1
    fits = np.zeros(len(text), bool)
    for a, n in zip(begins.tolist(), sizes.tolist()):
        fits[a : a + max(0, n - length + 1)] = True
    repeat = np.zeros(len(text), bool)
    before = -1
    for pos, lcp in sorted_suffixes(text, 257, memory, length):
        near = np.concatenate(([before], pos[:-1]))
        same = fits[pos] & (lcp >= length) & (near >= 0) & fits[near]
        repeat[pos[same]] = True
        repeat[near[same]] = True
        before = int(pos[-1]) if len(pos) else before
    at = np.flatnonzero(repeat)
    number = np.searchsorted(begins, at, "right") - 1
    return number, at - begins[number]


def sort_shards(parts: DataFrame, length: int, memory: int) -> DataFrame:
    """(key, digest, first, last): runs of strings that occur twice in their shard."""

    def sort(table: pa.Table) -> pa.Table:
        keys, digests = table["key"].to_pylist(), table["digest"].to_pylist()
        number, place = repeats_in_shard(table["data"].to_pylist(), length, memory)
        rows = []
        edges = np.searchsorted(number, np.arange(len(keys) + 1))
        for i in np.unique(number).tolist():
            rows += [(keys[i], digests[i], a, b) for a, b in runs(place[edges[i] : edges[i + 1]])]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "digest", "first", "last"])

    return parts.groupBy("shard").applyInArrow(sort, "key long, digest binary, first int, last int")


def cut_anew(groups: DataFrame, texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Stretches of stretches, keyed by a longer anchor under the key they come from; pat: their place in it."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(("pkey", "pdigest", "sha", "pat"), batch.columns))
            yield pa.RecordBatch.from_pydict(own | stretch_lists(batch.column(4).to_pylist(), length, anchor))

    parts = groups.select("key", "digest", F.col("rep.sha").alias("sha"), F.col("rep.at").alias("at"), F.col("rep.n").alias("n")).join(texts, "sha")
    data = F.substring("data", F.col("at") + 1, F.col("n") + (length - 1)).alias("data")
    again = cut(parts.select("key", "digest", "sha", "at", data).mapInArrow(look, ANEW), "anew")
    return flat_stretches(again, "pkey", "pdigest", "sha", "pat").withColumn("key", F.xxhash64("pkey", "key"))


def repeated_runs(found: DataFrame, texts: DataFrame, length: int, steps: list[int], shard_bytes: int, memory: int) -> DataFrame:
    """(key, digest, first, last): runs of strings, by place in their stretch, that occur twice among the
    stretches (key, digest, sha, at, n, inner) of found. steps: the anchors, the first of which keys found."""
    groups = found.groupBy("key", "digest").agg(F.count("*").alias("m"), F.max("inner").alias("inner"), F.min(F.struct("sha", "at", "n")).alias("rep"))
    groups = cut(groups, "groups")
    sizes = groups.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("rep.n") + length).alias("size"), F.max("inner").alias("inner")).where("kinds > 1 or inner").drop("inner", "kinds")
    fits = (F.col("size") * 2 <= shard_bytes) if len(steps) > 1 else F.lit(True)
    total, hot = sizes.agg(F.sum(F.when(fits, F.col("size"))), F.count(F.when(~fits, 1))).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    dealt = groups.join(sizes.where(fits).select("key"), "key").select(
        "key", "digest", F.col("rep.sha").alias("sha"), F.col("rep.at").alias("at"), F.col("rep.n").alias("n"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    )
    parts = dealt.join(texts, "sha").select("shard", "key", "digest", F.substring("data", F.col("at") + 1, F.col("n") + (length - 1)).alias("data"))
    out = cut(sort_shards(parts, length, memory), "sorted")
    out = out.unionByName(groups.where("m > 1").select("key", "digest", F.lit(0).alias("first"), (F.col("rep.n") - 1).alias("last")))
    if hot:
        # what m copies share is settled above; here the different stretches are held against each other
        anew = cut_anew(groups.join(sizes.where(~fits).select("key"), "key", "left_semi"), texts, length, steps[1])
        again = cut(of_repeated_keys(anew).withColumn("within", F.col("at")).withColumn("at", F.col("pat") + F.col("at")), "hot")
        deeper = again.join(repeated_runs(again, texts, length, steps[1:], shard_bytes, memory), ["key", "digest"])
        out = out.unionByName(deeper.select(F.col("pkey").alias("key"), F.col("pdigest").alias("digest"), (F.col("within") + F.col("first")).alias("first"), (F.col("within") + F.col("last")).alias("last")))
    return out


def shared_prints(texts: DataFrame) -> DataFrame:
    """(text, shared): how many fingerprints of a text are also another's; text: a hash of its digest."""
    flat = texts.select(F.xxhash64("sha").alias("text"), F.explode("prints").alias("print"))
    several = flat.groupBy("print").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo < hi").select("print")
    return cut(flat.join(several, "print").groupBy("text").agg(F.count("*").alias("shared")), "shared")


def repeated_strings(docs: DataFrame, length: int = 400, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared.

    n_shared counts fingerprints of passages that another document holds, too: it tells documents
    with shared passages of some 300 bytes, shorter than ``length``, of which nothing is removed.
    """
    prepare(docs.sparkSession)
    steps = anchors(length)
    every = cut(find_stretches(docs, length, steps[0]), "stretches")
    # equal texts: one stands for all
    copies = cut(every.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "texts")
    rows = every.join(copies, "sha", "left")
    alone = rows.where("rep is null or doc_id <=> rep")
    found = cut(of_repeated_keys(flat_stretches(alone, "sha")), "repeated")
    # the texts that any of this concerns, once
    wanted = found.select("sha").distinct()
    own = id_bytes(docs).withColumn("sha", F.sha2("data", 256))
    texts = cut(own.join(alone.select("doc_id", "sha").join(wanted, "sha", "left_semi"), ["doc_id", "sha"], "left_semi").dropDuplicates(["sha"]).select("sha", "data"), "texts")
    marks = repeated_runs(found, texts, length, steps, shard_bytes, memory)
    spans = found.join(marks, ["key", "digest"]).groupBy("sha").agg(F.collect_list(F.struct((F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("last") + length).alias("b"))).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sha, raw, spans_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans_):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((sha, sum(b - a for a, b in merged), len(merged), kept.hexdigest()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["sha", "removed", "runs", "kept"])

    removed = cut(texts.join(spans, "sha").select("sha", "data", "spans").mapInArrow(remove, "sha string, removed long, runs long, kept string"), "removed")
    counts = shared_prints(alone)
    # a text with copies is one whole repeat
    narrow = rows.select("doc_id", "sha", "n_bytes", F.size("prints").cast("long").alias("n_prints"), F.xxhash64("sha").alias("text"), (F.col("rep").isNotNull() | F.col("n").isNotNull()).alias("copied"))
    whole = F.col("copied") & (F.col("n_bytes") >= length)
    return narrow.join(removed, "sha", "left").join(counts, "text", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("runs", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(F.col("copied"), F.col("n_prints")).otherwise(F.coalesce("shared", F.lit(0).cast("long"))).alias("n_shared"),
    )
