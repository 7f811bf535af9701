"""Semantics of resolution, writes, schemas, ranges, queues, plans, stores and streams."""

import pytest

from siltstone.errors import ChecksumMismatch, Conflict, InvalidInput, InvalidState
from siltstone.functions.merge import Concat, Counter, Latest, ListAppend, capped_lists, operator
from siltstone.operators import queue, ranges, reads, resolve
from siltstone.operators.schema import Schema
from siltstone.operators.writes import WriteBatch
from siltstone.plans.scan import ScanPlan, ScanSplit
from siltstone.sources.store import LogStore, Manifest
from siltstone.streaming.ingest import ingest

LOG = "seq long, bucket int, cf string, key string, col int, op string, v string, exp long"


def log(spark, *ops):
    return spark.createDataFrame([(i, 0, "default", k, c, op, v, exp) for i, (k, c, op, v, exp) in enumerate(ops)], LOG)


def concat(rows, **options):
    found = resolve.rows(rows, {"v": (0, Concat(text=True), "v")}, **options)
    return {r.key: r.v for r in found.collect()}


def test_chain_and_delete(spark):
    rows = log(spark, ("a", 0, "put", "base", None), ("a", 0, "merge", "-a", None), ("a", 0, "merge", "-b", None), ("b", 0, "put", "x", None), ("b", 0, "delete", None, None), ("c", 0, "delete", None, None), ("c", 0, "merge", "a", None), ("c", 0, "merge", "b", None), ("d", 0, "merge", "abc", None))
    assert concat(rows) == {"a": "base-a-b", "c": "ab", "d": "abc"}
    assert concat(rows, at=1) == {"a": "base-a"}


def test_expired_versions_are_dropped_first(spark):
    rows = log(spark, ("a", 0, "put", "old", None), ("a", 0, "put", "new", 9), ("b", 0, "put", "x", 9), ("b", 0, "merge", "y", 9), ("c", 0, "put", "c", None))
    assert concat(rows, now=10) == {"a": "old", "c": "c"}
    assert concat(rows, now=8) == {"a": "new", "b": "xy", "c": "c"}


def test_counters(spark):
    rows = log(spark, ("a", 0, "put", "10", 1005), ("a", 0, "merge", "4", None))
    total = lambda now, bits=64: [int(r.t) for r in resolve.rows(rows, {"t": (0, Counter("c", bits), "v")}, now=now).collect()]
    assert total(1000) == [14] and total(1006) == [4]
    with pytest.raises(Exception, match="overflow"):
        resolve.rows(log(spark, ("a", 0, "put", str(2**32 - 1), None), ("a", 0, "merge", "1", None)), {"t": (0, Counter("u32", 32), "v")}).collect()
    with pytest.raises(InvalidInput):
        operator("median")


@pytest.mark.parametrize(("op", "want"), [(ListAppend(), "abc"), (ListAppend(cap=2), "ab"), (ListAppend(cap=2, keep="last"), "bc"), (ListAppend(cap=0), ""), (ListAppend(cap=9, keep="last"), "abc")])
def test_lists(spark, op, want):
    rows = log(spark, ("k", 0, "put", "x", None), ("k", 0, "put", "a", None), ("k", 0, "merge", "b", None), ("k", 0, "merge", "c", None))
    assert "".join(resolve.rows(rows, {"v": (0, op, "v")}).first().v or []) == want if want else True
    if op.cap is not None:
        assert "".join(capped_lists(resolve.live(rows), op).first().v) == want


def test_rows_of_nulls_are_not_there(spark):
    rows = log(spark, ("a", 0, "put", "x", None), ("a", 1, "put", "y", None), ("b", 1, "put", "z", None), ("a", 1, "delete", None, None))
    both = resolve.rows(rows, {"p": (0, Latest(), "v"), "q": (1, Latest(), "v")}).collect()
    assert sorted((r.key, r.p, r.q) for r in both) == [("a", "x", None), ("b", None, "z")]
    assert [r.key for r in resolve.rows(rows, {"q": (1, Latest(), "v")}).collect()] == ["b"]


def test_batches_fold_to_the_same(spark):
    ops = [(k, 0, op, None if op == "delete" else str(v), None) for v, (k, op) in enumerate([("a", "put"), ("a", "delete"), ("a", "merge"), ("b", "merge"), ("a", "merge"), ("b", "put"), ("b", "delete"), ("c", "merge"), ("c", "merge"), ("c", "delete"), ("c", "merge")])]
    rows = log(spark, *ops).withColumn("v", __import__("pyspark").sql.functions.col("v").cast("long"))
    total = lambda d: sorted((r.key, int(r.t)) for r in resolve.rows(d, {"t": (0, Counter(), "v")}).collect())
    assert all(total(resolve.fold_batches(rows, n)) == total(rows) for n in (1, 2, 3, 4, 100))


def test_write_batch(spark):
    b = WriteBatch(widths={"default": 2, "cold": 1}, ttl=5, no_ttl=frozenset({"cold"}))
    b.put(1, b"k", 0, b"v").merge(1, b"k", 1, b"w", ttl=9).delete(1, b"k", 0).put(2, b"j", 0, b"z", cf="cold")
    assert [(r.seq, r.op, r.exp) for r in b.rows(spark, 10, 100).collect()] == [(10, "put", 105), (11, "merge", 109), (12, "delete", None), (13, "put", None)]
    for bad in (lambda: b.put(0, b"", 2, b""), lambda: b.put(0, b"", 0, b"", cf="no"), lambda: b.put(70000, b"", 0, b"")):
        with pytest.raises(InvalidInput):
            bad()


def test_schema():
    base = Schema().edit().set_operator(2, "u64_counter").commit()
    assert base.version == 1 and base.family("default").operators == ("bytes", "bytes", "u64_counter")
    with pytest.raises(InvalidInput):
        base.edit().add_column(0).delete_column(1)
    with pytest.raises(InvalidInput):
        base.edit().add_column(0).commit(Schema())
    with pytest.raises(InvalidInput):
        base.family("none")


def test_ranges():
    assert ranges.subtract([(0, 9)], [(0, 1), (4, 5), (9, 9)]) == [(2, 3), (6, 8)]
    assert ranges.shrink([(0, 3)], [(2, 3)]) == [(0, 1)] and ranges.expand([(0, 1)], [(2, 9)], [(2, 3)]) == [(0, 3)]
    for bad, error in ((lambda: ranges.shrink([(0, 3)], [(0, 3)]), InvalidInput), (lambda: ranges.shrink([(0, 3)], [(3, 4)]), InvalidInput), (lambda: ranges.expand([(0, 3)], [(0, 9)], [(3, 4)]), Conflict), (lambda: ranges.normalise([(3, 1)]), InvalidInput)):
        with pytest.raises(error):
            bad()


def test_queue_moves_up_only(spark):
    view = spark.createDataFrame([(0, "k1", "a"), (0, "k2", "b"), (0, "k3", "c")], "bucket int, key string, v string")
    start = spark.createDataFrame([], "bucket int, cursor string")
    taken, moved = queue.poll(view, start, 2)
    assert sorted(r.key for r in taken.collect()) == ["k1", "k2"]
    back = queue.advance(moved, spark.createDataFrame([(0, "k1")], "bucket int, cursor string"))
    assert [r.key for r in queue.peek(view, back, 5).collect()] == ["k3"]
    with pytest.raises(InvalidInput):
        reads.first_rows(view, 0)


def test_splits(spark):
    view = spark.createDataFrame([(0, "z0"), (1, "z1"), (2, "m2a"), (2, "m2b"), (3, "a3")], "bucket int, key string")
    split = ScanPlan(((0, 3),)).splits()[0]
    before, after = split.split_after(2, "m2a")
    after = ScanSplit.from_json(after.to_json())
    assert [r.key for r in after.rows(view).orderBy("bucket", "key").collect()] == ["m2b", "a3"]
    assert before.rows(view).count() == 3
    with pytest.raises(InvalidInput):
        split.split_after(9, "")


def test_store_and_stream(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0
    store.append(WriteBatch().put(0, b"a", 0, b"1").rows(spark, 0, 0))
    store.append(WriteBatch().merge(0, b"a", 0, b"\xff").rows(spark, 1, 0))
    read = lambda log: [bytes(r.v) for r in resolve.rows(log, {"v": (0, Concat(), "v")}).collect()]
    assert read(store.read()) == [b"1\xff"] and read(store.read(1)) == [b"1"] and store.versions() == [1, 2]
    with pytest.raises(InvalidState):
        store.read(9)
    text = Manifest(1, last_seq=2, ranges=((0, 1),)).to_text()
    assert Manifest.from_text(text).ranges == ((0, 1),)
    with pytest.raises(ChecksumMismatch):
        Manifest.from_text(text.replace("last_seq", "last_see"))
    store.read().repartition(3).write.parquet(f"{tmp_path}/in")
    other = LogStore(spark, f"file://{tmp_path}/other")
    ingest(spark, f"file://{tmp_path}/in", store.schema, other, f"file://{tmp_path}/cp", 1)
    assert read(other.read()) == [b"1\xff"]
    ingest(spark, f"file://{tmp_path}/in", store.schema, other, f"file://{tmp_path}/cp-lost", 8)  # its batch 0 is in the store
    assert other.read().count() == 2


def test_pages(spark):
    pages = spark.createDataFrame([(f"p{i}",) for i in range(5)] + [("q",)], "key string")
    got = reads.prefix_page(pages, "p", "p0", 2).collect()
    assert [(r.key, r.has_more, r.next_start_after) for r in got] == [("p1", True, "p2"), ("p2", True, "p2")]
    assert [r.has_more for r in reads.prefix_page(pages, "p", "p2", 2).collect()] == [False, False]
