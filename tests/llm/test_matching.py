"""Suffix dedup, decontamination and MinHash against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import decontamination, minhash, suffix_dedup
from siltstone.llm.components import connected_components
from siltstone.llm.induced_sort import SymbolQueue, sorted_suffixes

from .conftest import table


@pytest.mark.parametrize("memory", [1, 6, 1000])
def test_induced_sort(memory):
    draw = np.random.default_rng(memory)
    for trial in range(60):
        t = draw.integers(0, draw.integers(1, 5) + 1, draw.integers(1, 70)).astype(np.uint16)
        t = np.tile(t[: max(1, len(t) // 4)], 4) if trial % 3 == 0 else t
        out = list(sorted_suffixes(t, 300, memory=memory))
        order, lcp = np.concatenate([o[0] for o in out]).tolist(), np.concatenate([o[1] for o in out]).tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for k in range(1, len(order)):
            a, b = t[order[k - 1] :].tolist(), t[order[k] :].tolist()
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def removal(rows, length):
    seen = Counter(d[i : i + length] for _, t in rows for d in [(t or "").encode()] for i in range(len(d) - length + 1))
    for i, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        yield i, len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "shard", "memory"), [(400, 4 << 20, 1 << 23), (40, 2000, 500), (40, 1 << 20, 1 << 20)])
def test_suffix_dedup(edge_docs, edge_rows, length, shard, memory):
    got = suffix_dedup.repeated_strings(edge_docs, length, shard, memory).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(removal(edge_rows, length))


def test_suffix_dedup_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r)[:5] for r in suffix_dedup.repeated_strings(docs).collect()) == Counter(removal(rows, 400))


@pytest.mark.parametrize("shard", [4 << 20, 20_000, 3_000])
def test_suffix_dedup_of_hot_passages(spark, shard):
    """Passages below and above the length, each in many different surroundings, and a periodic text."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    below, above, common = text(300), text(650), text(70)
    rows = [(i, text(r.randint(0, 300)) + [below, above, common, below + above][i % 4] + text(r.randint(0, 300))) for i in range(80)]
    rows += [(80, "ab" * 900), (81, "ab" * 300 + text(50)), (82, below + "x" + above), (83, above[:401]), (84, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r)[:5] for r in suffix_dedup.repeated_strings(docs, 400, shard).collect()) == Counter(removal(rows, 400))


def test_queues_of_a_whole_shard_go_to_disk(monkeypatch):
    spilled, spill = [], SymbolQueue._spill
    monkeypatch.setattr(SymbolQueue, "_spill", lambda self: (spilled.append(self.held), spill(self)))
    draw = np.random.default_rng(4)
    part = draw.integers(97, 123, 3000).astype(np.uint8).tobytes()
    texts = [draw.integers(97, 123, 39_999).astype(np.uint8).tobytes() + bytes([1 + i]) + part for i in range(95)]
    number, place = suffix_dedup.repeats_in_shard(texts, 400, suffix_dedup.MEMORY)
    assert spilled and max(spilled) < suffix_dedup.MEMORY
    assert sorted(zip(number.tolist(), place.tolist())) == [(i, 40_000 + k) for i in range(95) for k in range(2601)]


def test_shared_passages_below_the_length(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(330)
    rows = [(i, text(200) + passage + text(200)) for i in range(6)] + [(10 + i, text(700)) for i in range(6)] + [(20, passage), (21, "x" * 20_000), (22, None), (23, passage[:100])]
    got = {r.doc_id: r for r in suffix_dedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_shared > 0 and got[i].n_removed == 0 for i in [*range(6), 20])
    assert not any(got[i].n_shared for i in [*range(10, 16), 21, 22, 23])


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix_dedup.repeated_strings(no_docs).count() == 0


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window):
    wins = defaultdict(set)
    for name, t in items:
        w = WORD.findall((t or "").encode().lower())
        for i in range(max(0, len(w) - min(window, len(w) or 1) + 1) if w else 0):
            wins[tuple(w[i : i + min(window, len(w))])].add(str(name))
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[tuple(w[a : a + n])]
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1, 30, 10**6])
def test_decontamination(spark, edge_docs, edge_rows, block):
    long = edge_rows[7][1].split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[110:140])), (3, "ONE, two"), (4, None), (5, "!!"), (6, " ".join(long[5:15])), (7, "a b c"), (10, "one two"), (2, " ".join(long[110:140])), (8, " ".join(long[3:9] + long[2:9]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(edge_docs, benchmark, 10, block).drop("longest", "spans")
    assert Counter(map(tuple, got.collect())) == Counter(contamination(edge_rows, items, 10))


@pytest.mark.parametrize("block", [5, 10**6])
def test_hit_spans_are_cut_out(spark, block):
    item, other = " ".join(f"w{i}" for i in range(12)), " ".join(f"é{i}" for i in range(80))
    rows = [(1, f"{other}. {item.upper()}! {other}"), (1, other), (None, f"{item} {item}"), (2, f"a {item}"), (3, None), (None, f"{item}, {other}")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    benchmark = spark.createDataFrame([(7, item), (8, "not in any")], "item_id long, text string")
    got = decontamination.remove_spans(docs, benchmark, coverage=0.2, block_words=block)
    want = [(1, f"{other}.  ! {other}"), (1, other), (3, None), (None, f" , {other}")]
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter((i, t, len(t or "")) for i, t in want)
    assert decontamination.decontaminate(got, benchmark).where("contaminated").count() == 0


def test_nothing_to_decontaminate(spark, edge_docs, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(edge_docs, empty).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(no_docs, empty).count() == 0


def near(rows, n):
    sets = defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i].append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    ids = sorted((i for i in sets if i is not None))
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    for i in ids:
        for s in sets[i]:
            yield i, len(s), top(i), top(i) == i


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(spark, edge_rows, n):
    rows = [r for r in edge_rows if r[0] is not None]
    assert Counter(map(tuple, minhash.near_duplicates(table(spark, rows), n).collect())) == Counter(near(rows, n))


def test_minhash_of_many_near_copies(spark):
    draw = np.random.default_rng(3)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(150):
        text = list(base)
        for k in draw.integers(0, 300, 14):
            text[k] = f"x{draw.integers(0, 9999)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"y{draw.integers(0, 50)}" for _ in range(40))) for i in range(30)]
    assert Counter(map(tuple, minhash.near_duplicates(table(spark, rows), 2).collect())) == Counter(near(rows, 2))


def test_minhash_of_nothing(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_blocks_join_all_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 7 * 8 * 400)
    found = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 400, np.uint64))
    lanes = minhash.packed(minhash.minima(found, 1)).view(np.int64).tolist()
    members = spark.createDataFrame([(k, i, i, lanes) for i in range(30) for k in (1, 2)], "key long, node long, comp long, packed array<long>")
    sets = spark.createDataFrame([(i, bytearray(found.tobytes())) for i in range(30)], "node long, hashes binary")
    got = minhash.block_links(members, sets, 0.8)
    assert got.count() < 30 * 29 // 2
    comps = connected_components(got).select("component").distinct().collect()
    assert [r.component for r in comps] == [0]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 90), (95, 100)] + [(200, k) for k in range(150, 190)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {100: 90, 95: 90} | {k: 150 for k in [*range(151, 190), 200]}
    assert {k: v for k, v in got.items() if k != v} == want
