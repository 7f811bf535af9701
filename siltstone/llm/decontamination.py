"""Benchmark decontamination by a generalised suffix automaton of normalised items.

A-Z are lower-cased and words are runs of digits, letters and non-ASCII characters, so that
UTF-8 bytes can be split without decoding. The automaton holds every run of words of every item;
reading a document's words, it tracks the longest run ending at each word that some item holds.
Where that run has ``window`` words, they are hit; so are whole shorter items.

Items are taken in blocks of at most ``block_words`` words. The driver reads one block at a time and
sends it to one pass over the documents, in which each task builds its automaton once; so neither
holds more than a block, whatever the benchmark's size. With more than one block, rows are numbered
and the hits of all passes are joined by row. Only the runs of words that all occur in a block's
items are walked; any other word puts the automaton back to its root.

Defined cases: null or empty texts have no words and hit nothing; items without words are never
found; items with equal words are all found; rows that repeat an item_id count once; an empty
benchmark or table gives no hits or an empty result; null item ids are left out; rows that repeat a
doc_id, or have none, are judged each; very long texts are walked whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hold_memory, id_bytes, prepare

#: Everything but 0-9, a-z and the bytes of non-ASCII characters parts words (after lower-casing).
_PARTS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest int, spans array<struct<first:int,last:int>>"


def words(data: bytes) -> list[bytes]:
    return data.lower().translate(_PARTS).split()


class Automaton:
    """Generalised suffix automaton over words; state 0 is the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in text]) for name, text in items if text]
        for _, text in coded:
            last = 0
            for w in text:
                last = self._extend(last, w)
        #: Names of the items that hold a window, by its state; shorter items by theirs, with their length.
        self.windows: dict[int, set[str]] = {}
        self.whole: dict[int, tuple[int, set[str]]] = {}
        self.shortest = window
        for name, text in coded:
            if len(text) < window:
                at, _ = self.step(0, 0, text[0])
                for w in text[1:]:
                    at = self.next[at][w]
                self.whole.setdefault(at, (len(text), set()))[1].add(name)
                self.shortest = min(self.shortest, len(text))
            else:
                for _, _, state in self.ends(text):
                    self.windows.setdefault(state, set()).add(name)

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, parent: int, w: int) -> int:
        """The state of parent's string and w alone, cut off from longer strings if need be."""
        child = self.next[parent][w]
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(w) == child:
            self.next[parent][w] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # another item holds this run already
            return self._split(last, w)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, w)
        return new

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The longest run ending in w, from the longest before it."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        return (self.next[state][w], matched + 1) if w in self.next[state] else (0, 0)

    def ends(self, text: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, longest run, state of the last ``window`` words) wherever these are a window."""
        state = matched = 0
        for i, w in enumerate(text):
            state, matched = self.step(state, matched, w)
            if matched >= self.window:
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                yield i, matched, at

    def hits(self, text: list[int]) -> Iterator[tuple[int, int, set[str], int]]:
        """(first word, last word, items, longest run) of each hit."""
        for i, matched, at in self.ends(text):
            yield i - self.window + 1, i, self.windows[at], matched
        if not self.whole:
            return
        state = matched = 0
        for i, w in enumerate(text):
            at, matched = state, _ = self.step(state, matched, w)
            while at > 0:
                found = self.whole.get(at)
                if found and found[0] <= matched:
                    yield i - found[0] + 1, i, found[1], matched
                at = self.link[at]

    def scan(self, text: list[bytes]) -> Iterator[tuple[int, int, set[str], int]]:
        get = self.ids.get
        coded = [get(w, -1) for w in text]
        known = np.asarray(coded, np.int64) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - first >= self.shortest:
                for a, b, names, run in self.hits(coded[first:end]):
                    yield first + a, first + b, names, run


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most block_words words (one item at least), read one block at a time."""
    block: list[tuple[str, bytes]] = []
    room = block_words
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    for name, data in items.distinct().orderBy("item_id").toLocalIterator():
        n = len(words(bytes(data)))
        if block and n > room:
            yield block
            block, room = [], block_words
        block.append((name, bytes(data)))
        room -= n
    yield block


#: Of one text: which words are hit, the items, the longest run; none where nothing is hit.
Hits = tuple[np.ndarray, set[str], int] | None
Finder = Callable[[pa.RecordBatch, list[list[bytes]]], list[Hits]]


def scanned(automaton: Automaton, text: list[bytes]) -> Hits:
    hit, items, longest = None, set(), 0
    for first, last, found, run in automaton.scan(text):
        hit = np.zeros(len(text), bool) if hit is None else hit
        hit[first : last + 1] = True
        items |= found
        longest = max(longest, run)
    return None if hit is None else (hit, items, longest)


def spans_of(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
    return [{"first": a, "last": z - 1} for a, z in zip(edges[::2], edges[1::2])]


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, text: str) -> tuple[DataFrame, Callable[[], Finder]]:
    """docs for one more pass, perhaps with further columns, and what a task of that pass finds the hits of a batch with."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = item_blocks(benchmark, block_words)
    head = list(islice(blocks, 2))
    if len(head) == 1:
        sent = spark.sparkContext.broadcast(head[0])

        def by_automaton() -> Finder:
            automaton = Automaton([(n, words(d)) for n, d in sent.value], window)
            return lambda batch, texts: [scanned(automaton, t) for t in texts]

        return docs, by_automaton
    row, own = "row_" + "_".join(docs.columns), [f"{c}_of_" + "_".join(docs.columns) for c in ("spans", "items", "run")]
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = None
    for block in chain(head, blocks):
        part = cut(_pass(rows.select(row, F.coalesce(F.col(text), F.lit("").cast(docs.schema[text].dataType)).cast("binary")), row, block, window), "hits")
        found = part if found is None else found.unionByName(part)
    joined = found.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias(own[0]), F.flatten(F.collect_list("items")).alias(own[1]), F.max("run").alias(own[2]))

    def from_columns() -> Finder:
        def find(batch: pa.RecordBatch, texts: list[list[bytes]]) -> list[Hits]:
            out: list[Hits] = []
            for t, spans, items, run in zip(texts, *(batch.column(c).to_pylist() for c in own)):
                hit = np.zeros(len(t), bool)
                for s in spans or ():
                    hit[s["first"] : s["last"] + 1] = True
                out.append((hit, set(items), run) if spans else None)
            return out

        return find

    return rows.join(joined, row, "left"), from_columns


def _pass(rows: DataFrame, row: str, block: list[tuple[str, bytes]], window: int) -> DataFrame:
    """The rows that one block's items hit."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("decontamination")
        automaton = Automaton([(n, words(d)) for n, d in sent.value], window)
        for batch in batches:
            hits = [scanned(automaton, words(d)) for d in batch.column(1).to_pylist()]
            kept = [i for i, h in enumerate(hits) if h is not None]
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            columns = [pa.array([spans_of(hits[i][0]) for i in kept], span), pa.array([sorted(hits[i][1]) for i in kept], pa.list_(pa.string())), pa.array([hits[i][2] for i in kept], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *columns], [row, "spans", "items", "run"])

    return rows.mapInArrow(look, f"`{row}` long, spans array<struct<first:int,last:int>>, items array<string>, run int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """A row a document: counts, items found, the spans of hit words and the longest run."""
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
    ready, finder = with_hits(id_bytes(docs), benchmark, window, block_words, "data")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("decontamination")
        find = finder()
        for batch in batches:
            texts = [words(d) for d in batch.column("data").to_pylist()]
            rows = []
            for doc_id, text, h in zip(batch.column("doc_id").to_pylist(), texts, find(batch, texts)):
                hit, found, run = h or (np.zeros(0, bool), set(), 0)
                n = int(hit.sum())
                rows.append((doc_id, len(text), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0, run, spans_of(hit)))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return ready.mapInArrow(look, RESULT)


def remove_spans(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.2, window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """docs, all columns, row by row: hit words are cut out of the text, each run of them with the
    signs between giving way to one space; rows with hits over more than ``coverage`` of their words
    are dropped. n_chars, where it is a column, is counted anew in rows that were cut."""
    names, schema = docs.columns, docs.schema
    ready, finder = with_hits(docs, benchmark, window, block_words, "text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("decontamination")
        find = finder()
        for batch in batches:
            datas = [(t or "").encode() for t in batch.column("text").to_pylist()]
            texts = [words(d) for d in datas]
            hit = {k: h[0] for k, h in enumerate(find(batch, texts)) if h is not None}
            batch = batch.select(names)
            if not hit:
                yield batch
                continue
            kept = [k for k in range(len(texts)) if k not in hit or hit[k].sum() <= coverage * len(texts[k])]
            rest = {k: without(datas[k], hit[k]) for k in kept if k in hit}
            out = batch.take(pa.array(kept, pa.int64()))
            for name, count in (("text", lambda t: t), ("n_chars", len)):
                if name in names:
                    old = out.column(name)
                    new = [count(rest[k]) if k in rest else x for k, x in zip(kept, old.to_pylist())]
                    out = out.set_column(names.index(name), name, pa.array(new, old.type))
            yield out

    return ready.mapInArrow(look, schema)


def without(data: bytes, hit: np.ndarray) -> str:
    """The text without its hit words."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.lower().translate(_PARTS))]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
    parts, at = [], 0
    for a, z in zip(edges[::2], edges[1::2]):
        parts.append(data[at : places[a][0]])
        at = places[z - 1][1]
    return b" ".join([*parts, data[at:]]).decode()


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS t
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS t
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lengths WHERE len(ws) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
