"""Exact dedup and k-d sharding."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from siltstone.llm.exact_dedup import exact_dedup
from siltstone.llm.sharding import kd_shards


def test_exact_dedup(edge_docs, edge_rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in edge_rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in edge_rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want[(i, keep if len(ids) > 1 else i, len(ids), i == (keep if len(ids) > 1 else i), hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup(edge_docs).collect())) == want


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_shards(edge_docs, edge_rows, spark):
    rows = kd_shards(edge_docs, 5, ("key", "n")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in edge_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))


def test_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    big = docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "'src0' as source", "n_chars"))
    sizes = defaultdict(int)
    for r in kd_shards(big, 8).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.06 * min(sizes.values())


def test_shards_of_nothing(no_docs):
    assert kd_shards(no_docs).count() == 0
