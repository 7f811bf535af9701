"""Queries over stores on small tables of events, with values and sizes that the test tables lack."""

import base64

import pytest
from pyspark.sql import functions as F

from siltstone import catalogue, stored_catalogue  # noqa: F401  the second adds its queries to the first
from siltstone.coordinator import SingleDatabase
from siltstone.database import Database, Readable
from siltstone.errors import InvalidInput
from siltstone.inspection import Inspector
from siltstone.options import Config, ScanOptions


def events(spark, path, *rows):
    """A folder with an events table of (user_id, event_type, value), in order."""
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double")
    made.withColumn("props", F.lit("")).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_the_highest_value_may_be_zero_negative_or_null(spark, tmp_path):
    rows = [(17, "signup", 0.0), (18, "signup", -0.0), (18, "click", 0.004), (19, "click", -3.0), (19, "click", -2.0), (20, "click", -1.0), (20, "click", 1.0), (21, "click", None), (22, "click", None), (22, "click", -5.0), (23, "click", 9.0), (23, "error", 8.0)]
    found = catalogue.QUERIES["kv_store_custom_operator"](spark, events(spark, tmp_path, *rows)).collect()
    assert sorted((r.bucket, r.key, r.highest) for r in found if r.key != 21) == [(1, 17, 0), (2, 18, 0), (3, 19, -200), (4, 20, 100), (6, 22, -500)]
    assert [r.highest for r in found if r.key == 21] == [None]


def test_pages_of_a_bucket_are_cut_from_one_read(spark, tmp_path, monkeypatch):
    db = SingleDatabase.open(spark, f"file://{tmp_path}/db", Config(total_buckets=2))
    for i in range(9):
        db.put(0, bytes([1, i]), 0, bytes([i]))
    db.put(0, b"\2", 0, b"")
    db.global_snapshot()
    look = Inspector(db.reader())

    def one_by_one(**more):
        out = [look.scan(0, **more)]
        while out[-1]["has_more"]:
            out.append(look.scan(0, **more | {"start_after": base64.b64decode(out[-1]["next_start_after"]["b64"])}))
        return out

    for more in ({"limit": 4}, {"limit": 3, "prefix": b"\1"}, {"limit": 2, "prefix": b"\1", "start_after": b"\1\3"}, {"prefix": b"none"}):
        assert list(look.pages(0, **more)) == one_by_one(**more)
    with pytest.raises(InvalidInput):
        look.pages(0, limit=0)
    reads, rows = [], Readable.rows
    monkeypatch.setattr(Readable, "rows", lambda *a, **b: reads.append(a) or rows(*a, **b))
    made = events(spark, tmp_path, *[(16 * i + 5, "signup", float(i)) for i in range(10)])
    found = catalogue.QUERIES["kv_inspect_pages"](spark, made).collect()
    assert len(reads) == 1 and [(r.page, r.key, r.total, r.has_more) for r in found] == [(i // 3, 16 * i + 5, 100 * i, i < 9) for i in range(10)]


def test_blocks_are_cut_from_one_read(spark, tmp_path, monkeypatch):
    db = Database.open(spark, f"file://{tmp_path}/db", Config(total_buckets=1))
    db.put_batch(0, 0, ((bytes([i]), b"v") for i in range(8)))
    reads, rows = [], Readable.rows
    monkeypatch.setattr(Readable, "rows", lambda *a, **b: reads.append(a) or rows(*a, **b))
    keys = lambda blocks: [([k[0] for k, _ in block], after) for block, after in blocks]
    assert keys(db.blocks(0, size=3)) == [([0, 1, 2], b"\2\0"), ([3, 4, 5], b"\5\0"), ([6, 7], None)] and len(reads) == 1
    assert keys(db.blocks(0, size=4)) == [([0, 1, 2, 3], b"\3\0"), ([4, 5, 6, 7], b"\7\0"), ([], None)]
    assert keys(db.blocks(0, b"\2", options=ScanOptions(max_rows=4), size=2)) == [([2, 3], b"\3\0"), ([4, 5], None)] and keys(db.blocks(0, b"\x09")) == [([], None)]
    with pytest.raises(InvalidInput):
        next(db.blocks(0, size=0))
    begun = db.blocks(0, size=5)
    _, after = next(begun)
    db.put(0, b"\6", 0, b"later")
    db.delete(0, b"\7", 0)
    db.compact()
    db.vacuum()
    assert [block for block, _ in begun] == [[(bytes([i]), [b"v"]) for i in (5, 6, 7)]]
    assert [block for block, _ in db.blocks(0, after)] == [[(b"\5", [b"v"]), (b"\6", [b"later"])]]
    del reads[:]
    made = events(spark, tmp_path, *[(16 * i + 3, "signup", float(i)) for i in range(10)])
    found = catalogue.QUERIES["kv_store_resume"](spark, made).collect()
    assert len(reads) == 1 and sorted((r.bucket, r.key, r.total) for r in found) == [(3, 16 * i + 3, 100 * i) for i in range(10)]
