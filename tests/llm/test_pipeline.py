"""The whole pipeline on small tables, against plain Python stages."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import toxicity
from siltstone.llm.common import read

BENCH = [("b1", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("b2", "short item here")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def hits(ws):
    hit = [False] * len(ws)
    for _, item in BENCH:
        own = words(item)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
    return hit


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def folder(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.fixture()
def kept_stages(spark, monkeypatch):
    """What each stage returned, by name."""
    seen, stages = {}, []
    for name, stage in corpus_pipeline.STAGES:

        def noted(s, d, f, name=name, stage=stage):
            seen[name] = stage(s, d, f)
            return seen[name]

        stages.append((name, noted))
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    return seen


def test_stages(spark, tmp_path, edge_rows, kept_stages):
    mean = "you awful stinking blorp"
    rows = [r for r in edge_rows if len(r[1] or "") < 9000]
    rows += [(2, "only here under a repeated id"), (2, "only here under a repeated id"), (None, "no id but words of its own"), (None, "no id but words of its own")]
    rows += [(500 + i, f"{mean} number {i} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(40)]
    rows += [(None, mean + " without an id"), (600, BENCH[0][1]), (601, "clean words around " + " ".join(f"u{j}" for j in range(60)) + " " + BENCH[0][1] + " tail end")]
    docs = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    labels = [(i, 1, int((t or "").startswith(mean))) for i, t in rows if i is not None]
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, docs, labels)).collect()
    texts = lambda name: sorted(((r.doc_id, r.text) for r in kept_stages[name].collect()), key=str)
    machine = toxicity.fit(read(spark, str(tmp_path), "documents"), read(spark, str(tmp_path), "labels"))
    clean = sorted(((i, t) for i, t in rows if machine.score((t or "").encode()) < 0.5), key=str)
    assert texts("toxicity") == clean
    assert not any((t or "").startswith(mean) for _, t in clean) and len(clean) >= 70  # so few rows train it that it flags some others
    order = lambda r: (r[0] is None, r[0] or 0)
    groups = defaultdict(list)
    for r in clean:
        groups[norm(r[1])].append(r)
    once = texts("exact_dedup")
    assert sorted(norm(t) for _, t in once) == sorted(groups)
    assert all(order((i, t))[:2] == min(order(x) for x in groups[norm(t)]) for i, t in once)
    sets, left = {t: shingles(t) for _, t in once}, texts("minhash")
    linked = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    kept = [sets[t] for _, t in left]
    assert set(left) <= set(once) and len(set(left)) == len(left)
    assert not any(linked(a, b) for k, a in enumerate(kept) for b in kept[:k])
    assert all(any(linked(sets[t], b) for b in kept) for i, t in once if (i, t) not in left)
    after = {}
    for i, t in left:
        hit = hits(words(t))
        if sum(hit) <= 0.2 * len(hit):
            after[(i, " ".join(w for w, h in zip(words(t), hit) if not h))] = t
    assert sorted(((i, " ".join(words(t))) for i, t in texts("decontamination")), key=str) == sorted(after, key=str)
    library, want = Tokenizer.from_file(path("byte_bpe_50k.json")), []
    for i, t in texts("decontamination"):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or 2048
        want += [(i, len(p), zlib.crc32(p.tobytes())) for p in np.split(ids, range(first, len(ids), 2048))]
    assert sorted(((r.doc_id, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


def test_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [])).count() == 0
