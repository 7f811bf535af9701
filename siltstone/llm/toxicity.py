"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and their prefixes, hashed. The SELECTED terms that tell
the classes apart best (chi-square on the training rows) are the inputs; each has a linear weight
and a vector of FACTORS, and the product of two vectors weighs the pair, so that two terms that
are harmless alone count together. Training: Adam on a bounded sample of labelled rows
(``sample`` rows, drawn by a hash of the id; the bound is the parameter). Scoring: every whole
text, by a broadcast of SELECTED x (FACTORS + 1) numbers, whatever the table's size.

Defined cases: null or empty texts score by the bias alone; of rows that share a labelled id the
least text is learned from; very long texts are read whole; a label that repeats counts as its
largest value and null labels are left out; without labels of both classes every score is the
share of toxic labels (0 without labels); an empty table gives an empty result; repeated rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, cut, give_back, hold_memory, id_bytes, prepare
from .decontamination import words

HASH_BITS, SELECTED, FACTORS = 20, 4096, 8
PREFIXES = range(3, 9)
SAMPLE, EPOCHS, RATE, DECAY, BATCH = 12_000, 12, 0.02, 2e-4, 256
CACHED_WORDS = 300_000
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def terms(word: bytes) -> list[int]:
    """Hashes of the word as a whole and of its prefixes (counted in bytes)."""
    mask = (1 << HASH_BITS) - 1
    return [zlib.crc32(b"=" + word) & mask] + [zlib.crc32(b"^" + word[:n]) & mask for n in PREFIXES if len(word) >= n]


def text_terms(data: bytes) -> np.ndarray:
    found: set[int] = set()
    for w in set(words(data)):
        found.update(terms(w))
    return np.fromiter(found, np.int32, len(found))


class Machine:
    def __init__(self, chosen: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.chosen, self.bias, self.linear, self.factors = chosen, bias, linear, factors
        self.place = dict(zip(chosen.tolist(), range(len(chosen))))
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def inputs(self, word: bytes) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            found = self.cache[word] = tuple(p for t in terms(word) if (p := self.place.get(t)) is not None)
        return found

    def score(self, data: bytes) -> float:
        own = set().union(*map(self.inputs, set(words(data)))) if self.place else ()
        z = self.bias
        if own:
            i = np.fromiter(sorted(own), np.int64, len(own))
            v = self.factors[i]
            z += self.linear[i].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(texts: list[np.ndarray], labels: np.ndarray) -> Machine:
    n, toxic = len(labels), float(labels.sum()) if len(labels) else 0.0
    if not 0 < toxic < n:
        share = toxic / n if n else 0.0
        return Machine(np.empty(0, np.int64), 40.0 * (2 * share - 1), np.empty(0), np.empty((0, FACTORS)))
    both, bad = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    for t, toxic_text in zip(texts, labels):  # the terms of a text are distinct
        both[t] += 1
        if toxic_text:
            bad[t] += 1
    share = toxic / n
    expected = both * share
    chi = np.where(both >= 3, (bad - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - both / (n + 1)), 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:SELECTED])
    chosen = chosen[chi[chosen] > 6]
    place = np.full(1 << HASH_BITS, -1)
    place[chosen] = np.arange(len(chosen))
    inputs = [p[p >= 0] for p in (place[t] for t in texts)]
    draw = np.random.default_rng(7)
    state = [np.array([np.log(share / (1 - share))]), np.zeros(len(chosen)), draw.normal(0, 0.02, (len(chosen), FACTORS))]
    first, second, step = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state], 0
    for _ in range(EPOCHS):
        order = draw.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            x = np.zeros((len(rows), len(chosen)), np.float32)
            for k, r in enumerate(rows):
                x[k, inputs[r]] = 1
            bias, linear, factors = state
            sums = x @ factors
            z = bias + x @ linear + 0.5 * ((sums**2).sum(axis=1) - x @ (factors**2).sum(axis=1))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / len(rows)
            count = (x.T @ err)[:, None]
            slopes = [np.array([err.sum()]), x.T @ err + DECAY * linear, x.T @ (err[:, None] * sums) - count * factors + DECAY * factors]
            step += 1
            for p, g, m, s in zip(state, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(chosen, float(state[0][0]), state[1], state[2])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    prepare(docs.sparkSession)
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = cut(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "drawn")

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(2).cast(pa.int32()), "terms": pa.array([text_terms(d).tobytes() for d in batch.column(1).to_pylist()], pa.binary())})

    # a labelled id that repeats is learned from once, so that the sample bounds what reaches the driver
    once = id_bytes(docs).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("data").alias("data")).select("doc_id", "data", "toxic")
    rows = once.mapInArrow(inputs, "doc_id long, toxic int, terms binary")
    table = rows.toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    give_back()  # the driver's memory is bounded, too
    machine = train([t for c in table["terms"].chunks for t in byte_views(c, np.int32)], (table["toxic"].to_numpy() > 0).astype(float))
    del table
    give_back()
    return machine


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted."""
    m = fit(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((m.chosen, m.bias, m.linear, m.factors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("toxicity")
        machine = Machine(*sent.value)
        for batch in batches:
            scores = [machine.score(d) for d in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            out = [zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else True for i in ids]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": pa.array(out, pa.bool_()), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())})

    return id_bytes(docs).mapInArrow(score, RESULT)


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs, all columns, row by row, without the texts scored toxic; ids decide nothing."""
    m = fit(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((m.chosen, m.bias, m.linear, m.factors))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("toxicity")
        machine = Machine(*sent.value)
        for batch in batches:
            keep = [machine.score((t or "").encode()) < 0.5 for t in batch.column("text").to_pylist()]
            yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
