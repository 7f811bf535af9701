"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

A text is its words (A-Z lower-cased, parted at white space) and an end; each word is its ids in a
public vocabulary of words and word parts. For each place, attention over the ids before it in
its window weighs EXPERTS distributions over ids; their mixture is the probability of the id that
comes. Windows of WINDOW places overlap by WINDOW - STRIDE, which give later places their context
and are not scored again, so that each id is scored once, in masked batches.

From the corpus: counts of all words of all training documents (the base score, and the
distribution of ids that every expert leans on) by distributed sums; and the weights, by
federated training: every training document takes part, in one of ROUNDS rounds by a hash of its
id, dealt to trainers of about TRAINER_DOCS; each trains one pass and weights and expert counts are
averaged, first over the DEALT trainers of a task, then in groups of tasks. Texts that are dealt
out, to trainers and to blocks, are compressed many together.

Words meet the counts by blocks of BLOCK neighbouring ids, not by rows of documents: a block asks
once for each of its words, so that no vocabulary has to be broadcast.

Defined cases: null or empty texts are the end alone; without training documents the base is that
of N = V = 0 and the model stays as drawn; an id that repeats is scored each time; a null id counts as held
in (no remainder of 2); an empty table gives an empty result; very long texts are many windows; equal texts score alike;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_bytes, prepare
from .word_tokens import word_tokens

WIDTH, HIDDEN, EXPERTS, WINDOW, STRIDE = 16, 32, 16, 16, 12
INPUTS = 8192
BLOCK = 4096
ROUNDS, TRAINER_DOCS, DEALT, GROUP = 2, 512, 8, 16
#: Logits are held within this, so that their exponentials stay finite.
CLIP = np.float32(30)
ONES = np.ones(max(WINDOW, EXPERTS), np.float32)
#: Columns of a projection to queries, keys and values, with the scale of attention in the queries.
SCALED = np.where(np.arange(3 * WIDTH) < WIDTH, np.float32(WIDTH**-0.5), np.float32(1))
ALLOWED = np.tril(np.ones((WINDOW, WINDOW), np.float32))
BATCH, RATE, LEAN = 256, 0.01, 200.0
#: Windows of a batch that are taken through the model at once, so that what is between stays in a processor's cache.
CHUNK = 192
#: Stands for the end among words, which are bytes.
END = ""
#: Words of a task that are counted before they are handed on.
HELD_WORDS = 350_000
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def block_of(doc_id: int | None) -> int:
    return -1 if doc_id is None else doc_id // BLOCK


def count_words(docs: DataFrame) -> DataFrame:
    """(block, word, n): occurrences in training documents; words of other documents come with 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Counter] = {}

        def out(but: int | None = None) -> Iterator[pa.RecordBatch]:
            for block in [b for b in blocks if b != but]:
                c = blocks.pop(block)
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(c), block, np.int64)), "word": pa.array(list(c), pa.binary()), "n": pa.array(list(c.values()), pa.int64())})

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = blocks.setdefault(block_of(doc_id), Counter())
                words = data.lower().split()
                if is_held_out(doc_id):
                    for w in set(words):
                        c[w] += 0
                else:
                    c.update(words)
            if len(blocks) > 1 and sum(map(len, blocks.values())) > HELD_WORDS:
                yield from out(block_of(doc_id))  # ids come in order as a rule: the others are done
            if sum(map(len, blocks.values())) > 2 * HELD_WORDS:
                yield from out()
        yield from out()

    return id_bytes(docs).mapInArrow(count, "block long, word binary, n long")


def word_ids(counts: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """counts with the ids of each word, as bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer, end_id)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in values(batch.column(0))]
            found = tokens.look_up(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([found[w] for w in words], pa.binary())], ["word", "n", "ids"])

    return counts.select("word", "n").mapInArrow(encode, "word binary, n long, ids binary")


def values(column: pa.Array) -> list:
    """The values of a column of bytes, much faster than by to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


def flat_ids(chunks: list[pa.Array], width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each row has, and all ids, of a column of ids as bytes, read from its buffers."""
    sizes, parts = [np.zeros(0, np.int64)], []
    for c in (c for c in chunks if len(c)):
        _, offsets, data = c.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        sizes.append(np.diff(at) // width)
        if at[-1] > at[0]:
            parts.append(memoryview(data)[at[0] : at[-1]])
    return np.concatenate(sizes), np.frombuffer(b"".join(parts), f"<u{width}").astype(np.int64)


def id_counts(counted: DataFrame, width: int, size: int, ends: int, end_id: int) -> np.ndarray:
    """Occurrences of each id in the training documents, of each as a word's first, and words that it is first of: three sums an id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * size)
        for batch in batches:
            n = batch.column(0).to_numpy().astype(float)
            lengths, flat = flat_ids([batch.column(1)], width)
            first = flat[(np.cumsum(lengths) - lengths)[lengths > 0]]
            total += np.bincount(np.concatenate((flat, size + first, 2 * size + first)), np.concatenate((np.repeat(n, lengths), n[lengths > 0], np.ones(len(first)))), 3 * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.float64())})

    sums = counted.where("n > 0").select("n", "ids").mapInArrow(count, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(3 * size)
    out[sums["id"].to_numpy()] = sums["n"].to_numpy()
    out[[end_id, size + end_id]] += ends
    return out.reshape(3, size)


def add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """into[at] += rows, with repeats summed."""
    if len(at):
        order = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")  # 16 bits are sorted by radix
        places = at.take(order)
        starts = np.concatenate(([0], np.flatnonzero(places[1:] != places[:-1]) + 1))
        into[places[starts]] += np.add.reduceat(rows.take(order, axis=0), starts, axis=0)


class Model:
    """Weights as one flat vector, expert counts, and the common distribution of ids."""

    SHAPES = {"embed": (INPUTS, WIDTH), "place": (WINDOW, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "back": (WIDTH, WIDTH), "up": (WIDTH, HIDDEN), "up0": (HIDDEN,), "out": (HIDDEN, EXPERTS), "out0": (EXPERTS,)}

    def __init__(self, weights: np.ndarray, experts: np.ndarray, common: np.ndarray, start: int) -> None:
        self.weights, self.experts, self.common, self.start = weights.astype(np.float32), experts, common, start
        at = 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.weights[at : at + size].reshape(shape))
            at += size
        self.lean = LEAN * common[:, None]
        self.refresh()

    def refresh(self) -> None:
        """Each expert: its counts, leaning on the common distribution."""
        self.table = np.multiply(self.experts + self.lean, 1 / (self.experts.sum(axis=0) + LEAN), dtype=np.float64).astype(np.float32)

    @classmethod
    def drawn(cls, common: np.ndarray, start: int) -> Model:
        draw = np.random.default_rng(11)
        parts = [draw.normal(0, {"embed": 0.5, "place": 0.1}.get(name, shape[0] ** -0.5), shape) if len(shape) > 1 else np.zeros(shape) for name, shape in cls.SHAPES.items()]
        lean = common[:, None] * np.exp(draw.normal(0, 1.5, (len(common), EXPERTS)))
        return cls(np.concatenate([p.ravel() for p in parts]), lean / lean.sum(axis=0) * 20 * LEAN, common, start)

    def forward(self, inputs: np.ndarray, begin: int = 0) -> dict[str, np.ndarray]:
        """inputs: (windows, WINDOW) ids before each place. Places before ``begin`` only give context: they are keys and values, and have no mixture."""
        b, asks = len(inputs), WINDOW - begin
        code = inputs % INPUTS
        h = self.embed.take(code, axis=0)
        h += self.place
        scaled = self.qkv * SCALED
        qkv = (h.reshape(-1, WIDTH) @ scaled).reshape(b, WINDOW, 3 * WIDTH)
        q, k, v = qkv[:, begin:, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, CLIP, out=a)
        np.exp(a, out=a)
        a *= ALLOWED[begin:]
        a /= (a.reshape(-1, WINDOW) @ ONES[:WINDOW]).reshape(b, asks, 1)
        o = (a @ v).reshape(-1, WIDTH)
        h2 = o @ self.back
        h2.reshape(b, asks, WIDTH)[:] += h[:, begin:]
        u = h2 @ self.up
        u += self.up0
        np.maximum(u, 0, out=u)
        z = u @ self.out
        z += self.out0
        np.clip(z, -CLIP, CLIP, out=z)
        np.exp(z, out=z)
        z /= (z @ ONES[:EXPERTS])[:, None]
        return {"code": code, "h": h, "scaled": scaled, "q": q, "k": k, "v": v, "a": a, "o": o, "h2": h2, "u": u, "mix": z}

    def windows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, scored) of texts that lie one after another in ids; targets are -1 beyond a text."""
        begins = np.cumsum(lengths) - lengths
        per = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
        text = np.repeat(np.arange(len(lengths)), per)
        number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        place = (number * STRIDE)[:, None] + np.arange(WINDOW)
        inside = place < lengths[text][:, None]
        at = begins[text][:, None] + np.minimum(place, lengths[text][:, None] - 1)
        before = np.where(place == 0, self.start, ids[np.maximum(at - (place > 0), 0)])
        scored = inside & ((number == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
        return before, np.where(inside, ids[at], -1), scored

    def log_probabilities(self, ids: np.ndarray, lengths: np.ndarray, batch: int = 128) -> np.ndarray:
        """log10 probability of each id, in order.

        The same function as forward(). Nothing nonlinear stands between embedding and projections,
        so that these are taken once for each code; places that only give context are keys alone.
        """
        inputs, targets, scored = self.windows(ids, lengths)
        scaled = self.qkv * SCALED
        asks = np.concatenate((scaled[:, :WIDTH], self.up), axis=1)
        tables = [(self.embed @ m, self.place @ m) for m in (asks, scaled[:, WIDTH:])]
        tables[0][1][:, WIDTH:] += self.up0
        back_up = self.back @ self.up
        found = np.ones(targets.shape)
        codes, targets = inputs % INPUTS, np.maximum(targets, 0)
        firsts = scored[:, 0]
        for rows, begin in ((np.flatnonzero(firsts), 0), (np.flatnonzero(~firsts), WINDOW - STRIDE)):
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                code = codes[part]
                ask = tables[0][0].take(code[:, begin:], axis=0)
                ask += tables[0][1][begin:]
                give = tables[1][0].take(code, axis=0)
                give += tables[1][1]
                a = ask[:, :, :WIDTH] @ give[:, :, :WIDTH].transpose(0, 2, 1)
                np.minimum(a, CLIP, out=a)
                np.exp(a, out=a)
                a *= ALLOWED[begin:]
                o = (a @ give[:, :, WIDTH:]).reshape(-1, WIDTH)
                o /= (a.reshape(-1, WINDOW) @ ONES[:WINDOW])[:, None]
                u = o @ back_up
                u += ask[:, :, WIDTH:].reshape(-1, HIDDEN)
                np.maximum(u, 0, out=u)
                z = u @ self.out
                z += self.out0
                np.clip(z, -CLIP, CLIP, out=z)
                np.exp(z, out=z)
                p = np.einsum("ij,ij->i", z, self.table.take(targets[part, begin:].ravel(), axis=0))
                p /= z @ ONES[:EXPERTS]
                found[part, begin:] = p.reshape(len(part), -1)
        return np.log10(found[scored])

    def train(self, ids: np.ndarray, lengths: np.ndarray, seed: int) -> None:
        """One pass of Adam over the windows; expert counts follow the responsibilities."""
        inputs, targets, scored = self.windows(ids, lengths)
        order = np.random.default_rng(seed).permutation(len(inputs))
        slopes = np.zeros_like(self.weights)
        views, at = {}, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            views[name] = slopes[at : at + size].reshape(shape)
            at += size
        first, second, spare, step = np.zeros_like(slopes), np.zeros_like(slopes), np.empty_like(slopes), 0
        codes, goals, firsts = inputs.astype(np.int32), np.maximum(targets, 0).astype(np.int32), scored[:, 0]
        fresh, met = np.zeros_like(self.experts), []
        for n, at in enumerate(range(0, len(order), BATCH)):
            rows = order[at : at + BATCH]
            rows = rows[np.argsort(~firsts[rows], kind="stable")]
            total = max(1.0, float(scored[rows].sum()))
            slopes[:], inner = 0, []
            for part, begin in self._chunks(rows, int(firsts[rows].sum())):
                f = self.forward(codes[part], begin)
                t, s = goals[part, begin:].ravel(), scored[part, begin:].ravel().astype(np.float32)
                share = f["mix"] * self.table.take(t, axis=0)
                share *= (s / (share @ ONES[:EXPERTS]))[:, None]
                met.append((t, share))  # a place that is not scored has a share of 0
                dz = f["mix"]
                dz *= s[:, None]
                dz -= share
                dz /= np.float32(total)
                inner.append((f["code"].ravel(), self._inner_slopes(f, dz, views)))
            add_rows(views["embed"], *map(np.concatenate, zip(*inner)))
            step += 1
            first *= 0.9
            np.multiply(slopes, 0.1, out=spare)
            first += spare
            second *= 0.99
            np.multiply(slopes, slopes, out=spare)
            spare *= 0.01
            second += spare
            np.sqrt(second, out=spare)
            spare += 1e-8 * (1 - 0.99**step) ** 0.5
            np.divide(first, spare, out=spare)
            spare *= RATE * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
            self.weights -= spare
            if n % 8 == 7 or at + BATCH >= len(order):
                add_rows(fresh, *map(np.concatenate, zip(*met)))
                met.clear()
            if n % 64 == 63:
                self.experts *= 0.7
                self.experts += fresh
                fresh[:] = 0
                self.refresh()
        self.experts += fresh
        self.refresh()

    @staticmethod
    def _chunks(rows: np.ndarray, firsts: int) -> list[tuple[np.ndarray, int]]:
        """Parts of a batch, (windows, first place that is scored in any), given how many texts begin in its first windows.

        Most windows begin inside a text, where places before WINDOW - STRIDE give context and are not scored.
        """
        head = max(firsts, CHUNK // 3) if firsts else 0
        return [(rows[x : min(x + CHUNK, head)], 0) for x in range(0, min(head, len(rows)), CHUNK)] + [(rows[x : x + CHUNK], WINDOW - STRIDE) for x in range(head, len(rows), CHUNK)]

    def _slopes(self, f: dict, dz: np.ndarray, g: dict) -> None:
        """Adds the slopes of weights to g, given those of the mixture's logits (by place, from forward()'s ``begin`` on)."""
        add_rows(g["embed"], f["code"].ravel(), self._inner_slopes(f, dz, g))

    def _inner_slopes(self, f: dict, dz: np.ndarray, g: dict) -> np.ndarray:
        """The same but for the embedding, whose slopes are returned, a row for each place of f["code"]."""
        b, asks = f["q"].shape[:2]
        places = np.ones(len(dz), np.float32)
        g["out"] += f["u"].T @ dz
        g["out0"] += places @ dz
        du = dz @ self.out.T
        du *= f["u"] > 0
        g["up"] += f["h2"].T @ du
        g["up0"] += places @ du
        dh2 = du @ self.up.T
        g["back"] += f["o"].T @ dh2
        do = dh2 @ self.back.T
        inner = np.einsum("ij,ij->i", do, f["o"]).reshape(b, asks, 1)  # the mean slope of a place's keys, as they weigh
        do = do.reshape(b, asks, WIDTH)
        da = do @ f["v"].transpose(0, 2, 1)
        da -= inner
        da *= f["a"]
        dqkv, begin = np.empty((b, WINDOW, 3 * WIDTH), np.float32), WINDOW - asks
        dqkv[:, :begin, :WIDTH] = 0
        np.matmul(da, f["k"], out=dqkv[:, begin:, :WIDTH])
        np.matmul(da.transpose(0, 2, 1), f["q"], out=dqkv[:, :, WIDTH : 2 * WIDTH])
        np.matmul(f["a"].transpose(0, 2, 1), do, out=dqkv[:, :, 2 * WIDTH :])
        dqkv = dqkv.reshape(-1, 3 * WIDTH)
        g["qkv"] += (f["h"].reshape(-1, WIDTH).T @ dqkv) * SCALED
        dh = dqkv @ f["scaled"].T
        dh.reshape(b, WINDOW, WIDTH)[:, begin:] += dh2.reshape(b, asks, WIDTH)
        g["place"] += (np.ones(b, np.float32) @ dh.reshape(b, -1)).reshape(WINDOW, WIDTH)
        return dh


def packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, packed) of rows (key, doc_id, data): the texts of a batch with equal keys, compressed together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            order = np.argsort(keys, kind="stable")
            found, begins = np.unique(keys[order], return_index=True)
            texts, out = batch.select(["doc_id", "data"]), []
            for at in np.split(order, begins[1:]) if len(found) else ():
                part, sink = texts.take(pa.array(at)), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_batch(part)
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(out, pa.binary())], [key, "packed"])

    return rows.select(key, "doc_id", "data").mapInArrow(pack, f"{key} long, packed binary")


def unpacked(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of the rows of packed()."""
    parts = [pa.ipc.open_stream(p).read_all() for p in table["packed"].to_pylist()]
    ids, datas = (list(chain.from_iterable(p[c].to_pylist() for p in parts)) for c in ("doc_id", "data"))
    return ids, datas


def taking_part(docs: DataFrame, turn: int) -> DataFrame:
    """(doc_id, data) of the training documents of a round; each is in one of the ROUNDS rounds."""
    mark = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(ROUNDS))
    return id_bytes(docs).where((mark == turn) & F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True)))


def train_round(docs: DataFrame, model: Model, turn: int, tokenizer: str, end_id: int) -> Model:
    """One round over its documents: trainers, then means of a task's trainers, of groups of tasks, and of all."""
    spark = docs.sparkSession
    taken = taking_part(docs, turn)
    n = taken.select("doc_id").count()
    if not n:
        return model
    tasks = -(-n // (TRAINER_DOCS * DEALT))
    sent = spark.sparkContext.broadcast((model.weights, model.experts.astype(np.float32), model.common, model.start))

    def train(key: tuple, table: pa.Table) -> pa.Table:
        tokens = word_tokens(tokenizer, end_id)
        tokens.forget()  # what other tasks met: rare words for the most part
        dealt = sorted(zip(*unpacked(table)), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
        trainers = -(-len(dealt) // TRAINER_DOCS)
        weights, experts = 0.0, 0.0
        for k in range(trainers):
            own = Model(*(x.copy() if isinstance(x, np.ndarray) else x for x in sent.value))
            texts = [b" ".join(data.lower().split()).decode("utf-8", "replace") for _, data in dealt[k::trainers]]
            ids = [np.frombuffer(e, f"<u{tokens.width}") for e in tokens.encode(texts)]
            own.train(np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids]), key[0].as_py() * DEALT + k)
            weights, experts = weights + own.weights.astype(np.float64), experts + own.experts
        tokens.forget()
        mean_of = [pa.array([(x / trainers).astype(np.float32).tobytes()], pa.binary()) for x in (weights, experts)]
        return pa.table([pa.array([key[0].as_py() // GROUP], pa.int64()), pa.array([trainers], pa.int64()), *mean_of], ["part", "n", "weights", "experts"])

    def mean(table: pa.Table) -> pa.Table:
        n = np.asarray(table["n"].to_pylist(), float)
        out = {}
        for name in ("weights", "experts"):
            total = sum(np.frombuffer(w, np.float32).astype(np.float64) * k for w, k in zip(table[name].to_pylist(), n))
            out[name] = pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())
        return pa.table({"part": pa.array([table["part"][0].as_py() // GROUP], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), **out})

    schema = "part long, n long, weights binary, experts binary"
    dealt = packed(taken.withColumn("task", F.pmod(F.xxhash64("doc_id"), F.lit(tasks))), "task")
    parts = cut(dealt.groupBy("task").applyInArrow(train, schema), "trainers")
    while tasks > GROUP:
        parts, tasks = parts.groupBy("part").applyInArrow(mean, schema), -(-tasks // GROUP)
    final = mean(parts.orderBy("part", F.xxhash64("weights")).toArrow())
    shape = model.experts.shape
    return Model(np.frombuffer(final["weights"][0].as_py(), np.float32), np.frombuffer(final["experts"][0].as_py(), np.float32).reshape(shape).astype(np.float64), model.common, model.start)


def mixed(parts: np.ndarray, per_word: np.ndarray, share: np.ndarray, free: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log10 probability of each text of ``words`` words, one at least.

    parts: of each id; per_word: ids a word; share: weighted, of the corpus's words with the same
    first id (of all words for a word without ids); free: weight of the product over ids.
    """
    sums = np.concatenate(([0.0], np.cumsum(parts)))
    ends = np.cumsum(per_word)
    first = np.where(per_word > 0, parts[np.minimum(ends - per_word, len(parts) - 1)], 0.0)
    rest = sums[ends] - sums[ends - per_word]
    rest -= first
    rest = np.where(per_word > 0, np.exp(np.maximum(rest, -300) * np.log(10)), 0.0)
    rest *= free
    rest += share
    each = np.log(np.maximum(rest, 1e-300)) / np.log(10)
    each += first
    return np.add.reduceat(each, np.cumsum(words) - words)


def score_texts(docs: DataFrame, tokenizer: str, end_id: int = 49407, start_id: int = 49406) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    tokens = word_tokens(tokenizer, end_id)
    width, vocabulary = tokens.width, tokens.library.get_vocab_size()
    asked = cut(count_words(docs), "asked")
    counted = cut(word_ids(asked.groupBy("word").agg(F.sum("n").alias("n")), tokenizer, end_id), "counted")
    ends = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))).select("doc_id").count()
    sums = counted.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    found, *firsts = id_counts(counted, width, vocabulary, ends, end_id)
    model = Model.drawn((found + 1) / (found + 1).sum(), start_id)
    for turn in range(ROUNDS):
        model = train_round(docs, model, turn, tokenizer, end_id)
    sent = spark.sparkContext.broadcast((model.weights, model.experts, model.common, model.start, firsts))
    known = asked.select("block", "word").join(counted, "word").select("block", "word", "n", "ids")

    def score(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        *state, firsts = sent.value
        model = Model(*state)
        order = [*chain.from_iterable(map(values, words["word"].chunks)), END]
        place = dict(zip(order, range(len(order))))
        n = np.append(words["n"].to_numpy(), ends).astype(np.int64)
        size, pool = (np.append(x, last) for x, last in zip(flat_ids(words["ids"].chunks, width), (1, end_id)))
        begin = np.cumsum(size) - size
        seen, kinds_of = np.full(len(size), float(max(total, 1))), np.zeros(len(size))
        seen[size > 0], kinds_of[size > 0] = (f[pool[begin[size > 0]]] for f in firsts)
        share = n / np.maximum(seen + kinds_of, 1)
        free = np.where(seen > 0, kinds_of / np.maximum(seen + kinds_of, 1), 1.0)
        share[-1], free[-1] = 1, 0  # the end is its own id, whatever its count
        base_of = np.log10(n + 1) - np.log10(total + 1 * (kinds + 1))
        out: dict[str, list] = {c.split()[0]: [] for c in SCORES.split(", ")}
        doc_ids, datas = unpacked(texts)
        for at in range(0, len(datas), 256):
            lists = [[*data.lower().split(), END] for data in datas[at : at + 256]]
            counts = np.array(list(map(len, lists)), np.int64)
            w = np.fromiter(map(place.__getitem__, chain.from_iterable(lists)), np.int64, counts.sum())
            starts = np.cumsum(counts) - counts
            per = size[w]
            flat = pool[np.repeat(begin[w] - (np.cumsum(per) - per), per) + np.arange(per.sum())]
            parts = model.log_probabilities(flat, np.add.reduceat(per, starts))
            out["doc_id"] += doc_ids[at : at + 256]
            out["held_out"] += map(is_held_out, doc_ids[at : at + 256])
            out["n_tokens"] += counts.tolist()
            out["n_known"] += np.add.reduceat((n[w] > 0).astype(np.int64), starts).tolist()
            out["base_score"] += np.add.reduceat(base_of[w], starts).tolist()
            out["score"] += mixed(parts, per, share[w], free[w], counts).tolist()
        out["train_tokens"] = [total] * len(datas)
        return pa.table({c: pa.array(v, {"h": pa.bool_(), "b": pa.float64(), "s": pa.float64()}.get(c[0], pa.int64())) for c, v in out.items()})

    with_block = id_bytes(docs).withColumn("block", F.expr(f"coalesce((doc_id - pmod(doc_id, {BLOCK})) div {BLOCK}, -1L)"))
    return packed(with_block, "block").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, SCORES)
