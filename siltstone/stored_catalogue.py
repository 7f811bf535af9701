"""Queries through stores, snapshots, readers, queues and streams, each with its SQL over the source tables.

The log is that of ``catalogue`` as bytes: keys are big-endian, so that their order is the
numbers', values are 64-bit little-endian counters. Each query makes the store that it reads.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import ABOVE, NOW, OUT, TTL, WITH, event_log, query
from .coordinator import Coordinator, Governance, Reader, SingleDatabase
from .database import Database, Sample
from .errors import Conflict
from .functions.codec import big_endian, from_big_endian, list_payload, little_endian
from .functions.merge import Operators
from .inspection import Inspector, samples_frame
from .operators import ranges, resolve
from .operators.schema import Schema, schema_frame
from .options import Config, ManualClock, ReadOptions, ScanOptions
from .plans.scan import GlobalScanPlan, ShardSplit
from .streaming.ingest import ingest
from .streaming.queues import offers
from .typed import ListType, TypedDatabase, TypedReader, TypedScanPlan, TypedScanSplit
from .workspace import new_store

TTL_CONFIG = Config(ttl_enabled=True, clock="manual", total_buckets=16)


def counters() -> Schema:
    return Schema().edit().set_operator(0, "u64_counter").commit()


def stored(log: DataFrame) -> DataFrame:
    """The mutations of ``event_log`` as a database takes them; seq counts from 0."""
    return log.select((F.col("seq") - 1).alias("seq"), "bucket", "cf", big_endian(F.col("key")).alias("key"), "col", "op", little_endian(F.col("v"), 8).alias("v"), "exp")


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(event_log(spark, sf_dir))


def opened(spark: SparkSession, tag: str, config: Config | None = None, **more) -> Database:
    return Database.open(spark, new_store(spark, tag), config or Config(total_buckets=16), schema=more.pop("schema", None) or counters(), **more)


def add(db: Database, ops: DataFrame) -> None:
    """Mutations whose seqs are the source's, in order after what the database has."""
    db.next_seq = 0
    db.write_frame(ops)


def shown(view: DataFrame) -> DataFrame:
    return view.select("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key"), F.col("c0").cast("bigint").alias("total"))


TYPED = ReadOptions(raw=False)


@query(WITH + "SELECT * FROM view")
def kv_store_roundtrip(spark, sf_dir):
    """Two segments of counters as bytes."""
    db, ops = opened(spark, "roundtrip"), stored_events(spark, sf_dir)
    add(db, ops.where("seq < 4000"))
    add(db, ops.where("seq >= 4000"))
    return shown(db.view(TYPED))


@query(WITH + "SELECT bucket, key, string_agg(event_type, '' ORDER BY seq) AS joined FROM live GROUP BY bucket, key")
def kv_store_concat(spark, sf_dir):
    """Bytes joined in order, read through a compacted base and later segments."""
    db = opened(spark, "concat", schema=Schema())
    ops = stored_events(spark, sf_dir).drop("v").join(event_log(spark, sf_dir).select((F.col("seq") - 1).alias("seq"), F.encode("event_type", "UTF-8").alias("v")), "seq")
    add(db, ops.where("seq < 3000"))
    add(db, ops.where("seq >= 3000 and seq < 5000"))
    db.compact()
    add(db, ops.where("seq >= 5000"))
    return db.view().select("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key"), F.decode("c0", "UTF-8").alias("joined"))


@query(WITH + "SELECT * FROM view")
def kv_store_compacted(spark, sf_dir):
    """A base, a folded run of deltas above it, and a tail."""
    db, ops = opened(spark, "compacted"), stored_events(spark, sf_dir)
    add(db, ops.where("seq < 2000"))
    db.compact()
    add(db, ops.where("seq >= 2000 and seq < 4000"))
    add(db, ops.where("seq >= 4000 and seq < 6000"))
    db.compact(deltas_only=True)
    add(db, ops.where("seq >= 6000"))
    return shown(db.view(TYPED))


@query(TTL + "SELECT bucket, key, CAST(sum(v) AS BIGINT) AS total FROM live GROUP BY bucket, key")
def kv_store_compacted_ttl(spark, sf_dir):
    """Folded at one time and read at a later one: what expires in between must come apart again."""
    clock = ManualClock(2000)
    db, ops = opened(spark, "compacted-ttl", TTL_CONFIG, clock=clock), stored_events(spark, sf_dir)
    add(db, ops.where("seq < 3000"))
    db.compact()
    clock.set(4000)
    add(db, ops.where("seq >= 3000"))
    db.compact()
    clock.set(NOW)
    return shown(db.view(TYPED))


@query(WITH + "SELECT bucket, key, CASE WHEN count(*) FILTER (op = 'delete') = 0 THEN 'kept' ELSE 'deleted once' END AS state, count(*) AS versions FROM log GROUP BY bucket, key")
def kv_store_log(spark, sf_dir):
    """The stored log itself, versions counted."""
    db = opened(spark, "log")
    add(db, stored_events(spark, sf_dir))
    state = F.when(F.count(F.when(F.col("op") == "delete", 1)) == 0, "kept").otherwise("deleted once").alias("state")
    return db.log("default").groupBy("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key")).agg(state, F.count("*").alias("versions"))


@query(WITH.replace("FROM events)", "FROM events WHERE event_id <= 4000)") + "SELECT * FROM view")
def kv_store_snapshot(spark, sf_dir):
    """A snapshot read after later writes, a compaction and a vacuum."""
    db, ops = opened(spark, "snapshot"), stored_events(spark, sf_dir)
    add(db, ops.where("seq < 4000"))
    id = db.snapshot()
    add(db, ops.where("seq >= 4000"))
    db.compact()
    db.vacuum()
    return shown(db.at_snapshot(id).view(TYPED))


@query(WITH.replace("FROM events)", "FROM events WHERE event_id <= 2000 OR event_id > 6000)") + "SELECT * FROM view")
def kv_store_restore(spark, sf_dir):
    """Put back to a snapshot, then written to again."""
    db, ops = opened(spark, "restore"), stored_events(spark, sf_dir)
    add(db, ops.where("seq < 2000"))
    id = db.snapshot()
    add(db, ops.where("seq >= 2000 and seq < 6000"))
    again = Database.open_from_snapshot(spark, db.path, id, db.config)
    add(again, ops.where("seq >= 6000"))
    return shown(Database.resume(spark, db.path, db.config).view(TYPED))


@query(WITH.replace("FROM events)", "FROM events WHERE event_id <= 3000 OR event_id > 5000)") + "SELECT * FROM view")
def kv_store_branch(spark, sf_dir):
    """A branch of a snapshot with writes of its own, after it has copied what it took."""
    db, ops = opened(spark, "source"), stored_events(spark, sf_dir)
    add(db, ops.where("seq < 3000"))
    id = db.snapshot()
    add(db, ops.where("seq >= 3000 and seq < 5000"))
    branch = Database.branch(spark, new_store(spark, "branch"), db.path, id, db.config)
    add(branch, ops.where("seq >= 5000"))
    branch.adopt()
    return shown(branch.view(TYPED))


@query(WITH + "SELECT bucket, key, count(*) AS versions FROM log WHERE seq > 2001 AND seq <= 6000 GROUP BY bucket, key")
def kv_store_tail(spark, sf_dir):
    """The log's tail behind a checkpoint."""
    from .streaming.ingest import replay

    db = opened(spark, "tail")
    add(db, stored_events(spark, sf_dir).where("seq < 6000"))
    return replay(db.store, None, 2000).groupBy("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key")).agg(F.count("*").alias("versions"))


def four_shards(spark: SparkSession, ops: DataFrame, tag: str) -> tuple[list[Database], Coordinator]:
    """Shards of four buckets each, the log dealt to them, and one global snapshot."""
    shards = [opened(spark, f"{tag}-{i}", Config(total_buckets=16, reload_tolerance_seconds=0), ranges=[(4 * i, 4 * i + 3)]) for i in range(4)]
    coordinator = Coordinator(spark, new_store(spark, f"{tag}-global"), retention=2)
    for db in shards:
        add(db, ops.where(ranges.holds(db.manifest().ranges)))
    coordinator.materialise(coordinator.take(16, [db.snapshots.load(db.snapshot()) for db in shards]))
    return shards, coordinator


@query(WITH + "SELECT bucket, key, total, 'all' AS part FROM view UNION ALL SELECT bucket, key, total, 'bucket 7' FROM view WHERE bucket = 7 AND key >= 20 UNION ALL SELECT bucket, key, total, 'limit' FROM (SELECT *, row_number() OVER (ORDER BY key) AS n FROM view WHERE bucket = 9) WHERE n <= 3")
def kv_reader_current(spark, sf_dir):
    """A reader that follows CURRENT over four shards, after the second global snapshot."""
    ops = stored_events(spark, sf_dir)
    shards, coordinator = four_shards(spark, ops.where("seq < 4000"), "reader")
    reader = Reader(spark, coordinator.folder.path, config=shards[0].config)
    for db in shards:
        add(db, ops.where("seq >= 4000").where(ranges.holds(db.manifest().ranges)))
    coordinator.materialise(coordinator.take(16, [db.snapshots.load(db.snapshot()) for db in shards]))
    reader.refresh()
    found = shown(reader.view(TYPED)).withColumn("part", F.lit("all"))
    low = F.lit(20).cast("long")
    one = shown(reader.scan(7, (20).to_bytes(8, "big"), None, ScanOptions(raw=False))).where(F.col("key") >= low).withColumn("part", F.lit("bucket 7"))
    few = shown(reader.scan(9, None, None, ScanOptions(raw=False, max_rows=3))).withColumn("part", F.lit("limit"))
    return found.unionByName(one).unionByName(few)


@query(WITH.replace("FROM events)", "FROM events WHERE event_id <= 4000)") + "SELECT * FROM view")
def kv_reader_fixed(spark, sf_dir):
    """A reader that stays at the first global snapshot."""
    ops = stored_events(spark, sf_dir)
    shards, coordinator = four_shards(spark, ops.where("seq < 4000"), "fixed")
    for db in shards:
        add(db, ops.where("seq >= 4000").where(ranges.holds(db.manifest().ranges)))
    coordinator.materialise(coordinator.take(16, [db.snapshots.load(db.snapshot()) for db in shards]))
    return shown(Reader(spark, coordinator.folder.path, 0, shards[0].config).view(TYPED))


@query("SELECT CAST(id AS BIGINT) AS id, 16 AS total_buckets, 4 AS shards, id = 4 AS current FROM (VALUES (1), (3), (4)) t(id)")
def kv_global_snapshots(spark, sf_dir):
    """Five global snapshots of which retention keeps two, one that is retained, and the current one."""
    shards, coordinator = four_shards(spark, stored_events(spark, sf_dir).where("seq < 400"), "list")
    for turn in range(1, 5):
        coordinator.materialise(coordinator.take(16, [db.snapshots.load(db.snapshot()) for db in shards]))
        if turn == 1:
            coordinator.retain(1)
    coordinator.expire(4)
    return coordinator.frame().select("id", "total_buckets", "shards", "current")


@query(WITH + "SELECT CAST(bucket // 4 AS INT) AS split, CASE WHEN bucket // 4 <> 1 THEN 'whole' WHEN bucket < 6 OR (bucket = 6 AND key <= 40) THEN 'before' ELSE 'after' END AS part, bucket, key, total FROM view WHERE key >= 10 AND key < 90")
def kv_global_scan_plan(spark, sf_dir):
    """A plan's splits, sent as JSON, one of them split again."""
    shards, coordinator = four_shards(spark, stored_events(spark, sf_dir), "plan")
    plan, out = GlobalScanPlan(coordinator.load(), (10).to_bytes(8, "big"), (90).to_bytes(8, "big")), None
    for i, split in enumerate(plan.splits()):
        halves = zip(("before", "after"), split.split_after(6, (40).to_bytes(8, "big"))) if i == 1 else [("whole", split)]
        for part, s in halves:
            rows = shown(ShardSplit.from_json(s.to_json()).scanner(spark, shards[0].config, ScanOptions(raw=False)))
            rows = rows.select(F.lit(i).alias("split"), F.lit(part).alias("part"), *OUT)
            out = rows if out is None else out.unionByName(rows)
    return out


@query(WITH + "SELECT 'before' AS state, * FROM view WHERE bucket < 8 UNION ALL SELECT 'after', * FROM view WHERE bucket < 3 OR bucket = 6 OR bucket = 7")
def kv_store_shrink(spark, sf_dir):
    """A shard gives up buckets 3 to 5; the snapshot of before still has them."""
    db = opened(spark, "shrink", ranges=[(0, 7)])
    add(db, stored_events(spark, sf_dir).where("bucket < 8"))
    id = db.shrink([(3, 5)])
    before = shown(db.at_snapshot(id).view(TYPED)).select(F.lit("before").alias("state"), *OUT)
    return before.unionByName(shown(db.view(TYPED)).select(F.lit("after").alias("state"), *OUT))


@query(ABOVE + "SELECT bucket, key, total FROM view WHERE (bucket < 4 OR bucket IN (10, 11)) AND (bucket <> 10 OR key > 42)")
def kv_store_expand(spark, sf_dir):
    """A shard takes two buckets, and the cursor of one, from another's snapshot, and copies them."""
    ops = stored_events(spark, sf_dir)
    source, db = opened(spark, "expand-source", ranges=[(8, 15)]), opened(spark, "expand", ranges=[(0, 3)])
    add(source, ops.where("bucket >= 8"))
    source.advance_truncation_cursor(10, "default", (42).to_bytes(8, "big"))
    source.advance_truncation_cursor(12, "default", (15).to_bytes(8, "big"))
    id = source.snapshot()
    source.compact()
    add(db, ops.where("bucket < 4"))
    db.expand(source.path, id, [(10, 11)])
    db.adopt()
    db.wait_for_adoption(0)
    return shown(db.view(TYPED))


@query(f"SELECT event_id // 100 AS file, CAST(user_id % 16 AS INT) AS bucket, bool_and(event_type = 'purchase' AND event_id + 500 <= {NOW}) AS expired, user_id % 2 = 0 AND max(user_id) <= 32 + user_id % 16 AS truncated FROM events GROUP BY event_id // 100, user_id % 16, user_id % 2")
def kv_dead_parts(spark, sf_dir):
    """Parts of a log, 100 seqs and a bucket each, that are wholly expired or cut off."""
    log = event_log(spark, sf_dir).withColumn("part", F.floor(F.col("seq") / 100).cast("bigint"))
    lasting = F.count(F.when(F.col("exp").isNull() | (F.col("op") == "delete"), 1)).alias("lasting")
    stats = log.groupBy("part", "bucket", "cf").agg(F.count("*").alias("rows"), lasting, F.max("exp").alias("last_exp"), F.max("key").alias("hi"))
    cursors = spark.createDataFrame([(b, "default", 32 + b) for b in range(0, 16, 2)], "bucket int, cf string, cursor long")
    return resolve.dead_parts(stats, NOW, cursors).select(F.col("part").alias("file"), "bucket", "expired", "truncated")


@query(TTL.replace("WITH log AS (", "WITH log AS (SELECT * FROM (").replace("FROM events WHERE", "FROM events WHERE event_id > 0 AND").replace("),\nfloors", ") WHERE bucket % 2 = 1 OR key > 32 + bucket),\nfloors") + "SELECT bucket, key, CAST(sum(v) AS BIGINT) AS total FROM live GROUP BY bucket, key")
def kv_store_drop_dead(spark, sf_dir):
    """A store read after its dead parts were dropped, with cursors and expired segments."""
    clock = ManualClock(NOW)
    db, ops = opened(spark, "dead", TTL_CONFIG, clock=clock), stored_events(spark, sf_dir)
    for lo in range(0, 10_000, 2500):
        add(db, ops.where(f"seq >= {lo} and seq < {lo + 2500} and op = 'merge' and exp is not null"))
        add(db, ops.where(f"seq >= {lo} and seq < {lo + 2500} and not (op = 'merge' and exp is not null)"))
    add(db, ops.where("seq >= 10000"))
    for b in range(0, 16, 2):
        db.advance_truncation_cursor(b, "default", (32 + b).to_bytes(8, "big"))
    db.drop_dead()
    return shown(db.view(TYPED))


def list_ops(spark: SparkSession, sf_dir: str, expiring: bool = False) -> DataFrame:
    """One element a mutation: the event's props."""
    log = event_log(spark, sf_dir)
    element = F.struct(F.encode("props", "UTF-8").alias("v"), F.col("exp").alias("exp"))
    return log.select((F.col("seq") - 1).alias("seq"), "bucket", "cf", big_endian(F.col("key")).alias("key"), "col", "op", list_payload(F.array(element), expiring).alias("v"))


def joined_lists(view: DataFrame) -> DataFrame:
    return view.select("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key"), F.array_join(F.transform("c0", lambda e: F.decode(e, "UTF-8")), "|").alias("items"))


def typed_lists(spark: SparkSession, tag: str, kind: ListType, config: Config | None = None, **more) -> TypedDatabase:
    db = TypedDatabase.open(spark, new_store(spark, tag), config or Config(total_buckets=16), schema=Schema(0, {}), **more)
    db.edit().add_list_column(0, kind).commit()
    return db


@query(WITH + "SELECT bucket, key, array_to_string((list(props ORDER BY seq))[-3:], '|') AS items FROM live GROUP BY bucket, key")
def kv_typed_list(spark, sf_dir):
    """A list column that keeps its last three elements, before and after a compaction."""
    db, ops = typed_lists(spark, "typed", ListType(3, "last")), list_ops(spark, sf_dir)
    add(db.raw, ops.where("seq < 5000"))
    db.raw.compact()
    add(db.raw, ops.where("seq >= 5000"))
    return joined_lists(db.view())


@query(WITH + f"SELECT bucket, key, coalesce(array_to_string((list(props ORDER BY seq) FILTER (exp IS NULL OR exp > {NOW}))[1:3], '|'), '') AS items FROM live GROUP BY bucket, key")
def kv_typed_element_ttl(spark, sf_dir):
    """The first three elements that are alive; folded at an earlier time, and then read."""
    clock = ManualClock(1000)
    db, ops = typed_lists(spark, "element-ttl", ListType(3, "first", True), clock=clock), list_ops(spark, sf_dir, True)
    add(db.raw, ops.where("seq < 4000"))
    db.raw.compact()
    add(db.raw, ops.where("seq >= 4000"))
    clock.set(NOW)
    return joined_lists(db.view())


@query(WITH + "SELECT pos, b AS bucket, k AS key, array_to_string((list(props ORDER BY seq) FILTER (props IS NOT NULL))[1:2], '|') AS items FROM (VALUES (0, 3, 3), (1, 5, 5), (2, 3, 3), (3, 1, 999999937), (4, 1, 17)) w(pos, b, k) LEFT JOIN live ON live.key = k AND live.bucket = b GROUP BY pos, b, k")
def kv_typed_multi_get(spark, sf_dir):
    """Rows by position through the typed API; missing and repeated keys keep their places."""
    db = typed_lists(spark, "typed-get", ListType(2))
    add(db.raw, list_ops(spark, sf_dir))
    keys = [(3, 3), (5, 5), (3, 3), (1, 999999937), (1, 17)]
    found = db.multi_get([(b, k.to_bytes(8, "big")) for b, k in keys])
    rows = [(i, b, k, None if row is None else "|".join(e.decode() for e in row[0])) for i, ((b, k), row) in enumerate(zip(keys, found))]
    return spark.createDataFrame(rows, "pos int, bucket int, key int, items string")


@query(WITH + "SELECT w.pos, w.bucket, w.key, view.total FROM (VALUES (0, 3, 3), (1, 5, 5), (2, 3, 3), (3, 1, 999999937), (4, 1, 17)) w(pos, bucket, key) LEFT JOIN view ON view.key = w.key AND view.bucket = w.bucket")
def kv_store_lookup(spark, sf_dir):
    """A table of wanted keys, of any size, joined to what they resolve to."""
    db = opened(spark, "lookup")
    add(db, stored_events(spark, sf_dir))
    wanted = spark.createDataFrame([(0, 3, 3), (1, 5, 5), (2, 3, 3), (3, 1, 999999937), (4, 1, 17)], "pos int, bucket int, k long").withColumn("key", big_endian(F.col("k")))
    return db.lookup(wanted, TYPED).select("pos", "bucket", from_big_endian(F.col("key")).cast("int").alias("key"), F.col("c0").cast("bigint").alias("total"))


EVOLVED = """
WITH log AS (
  SELECT event_id AS seq, CAST(user_id % 16 AS INT) AS bucket, user_id AS key, event_type, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op, CAST(round(value * 100) AS BIGINT) AS v FROM events),
old AS (SELECT bucket, key, max(seq) AS f FROM log WHERE seq <= 4000 GROUP BY bucket, key),
t AS (SELECT seq, bucket, key, op, v FROM log),
floors AS (SELECT key, max(seq) FILTER (op <> 'merge') AS f FROM t GROUP BY key),
c1 AS (SELECT t.bucket, t.key, CAST(sum(v) AS BIGINT) AS total FROM t JOIN floors USING (key) WHERE op <> 'delete' AND (f IS NULL OR seq >= f) GROUP BY t.bucket, t.key),
added AS (SELECT bucket, key, 1000 AS v FROM old UNION ALL SELECT bucket, key, 1 FROM log WHERE seq > 4000 AND event_type = 'click'),
c0 AS (SELECT bucket, key, CAST(sum(v) AS BIGINT) AS clicks FROM added GROUP BY bucket, key)
SELECT bucket, key, clicks, total FROM c0 FULL JOIN c1 USING (bucket, key)
"""


@query(EVOLVED)
def kv_store_schema(spark, sf_dir):
    """A counter column put before the first, with a default that older rows hold; folded across both versions."""
    db, ops = opened(spark, "schema"), stored_events(spark, sf_dir)
    add(db, ops.where("seq < 4000"))
    db.commit(db.edit_schema().add_column(0, "u64_counter", (1000).to_bytes(8, "little")))
    late = ops.where("seq >= 4000")
    clicks = event_log(spark, sf_dir).where("seq > 4000 and event_type = 'click'").select(
        (F.col("seq") - 1).alias("seq"), "bucket", "cf", big_endian(F.col("key")).alias("key"), F.lit(0).alias("col"), F.lit("merge").alias("op"), little_endian(F.lit(1), 8).alias("v"), F.lit(None).cast("bigint").alias("exp")
    )
    add(db, late.withColumn("col", F.lit(1)).unionByName(clicks))
    db.compact()
    view = db.view(TYPED)
    return view.select("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key"), F.col("c0").cast("bigint").alias("clicks"), F.col("c1").cast("bigint").alias("total"))


@query(WITH + "SELECT bucket, key, total, 'plain' AS family FROM view UNION ALL " + "SELECT bucket, key, CAST(sum(v) AS BIGINT), 'default' FROM (" + TTL + "SELECT * FROM live) GROUP BY bucket, key")
def kv_store_families(spark, sf_dir):
    """The same log in two families, of which one takes no TTL."""
    clock = ManualClock(NOW)
    schema = counters().edit().ensure_family("plain", value_has_ttl=False).add_column(0, "u64_counter", family="plain").commit()
    db, ops = opened(spark, "families", TTL_CONFIG, clock=clock, schema=schema), stored_events(spark, sf_dir)
    add(db, ops.unionByName(ops.withColumn("cf", F.lit("plain"))))
    default, plain = (shown(db.view(ReadOptions(family=f, raw=False))).withColumn("family", F.lit(f)) for f in ("default", "plain"))
    return default.unionByName(plain)


@query(WITH + "SELECT bucket, key, max(v) AS highest FROM live GROUP BY bucket, key")
def kv_store_custom_operator(spark, sf_dir):
    """A merge operator of the caller's, found by its id in the stored schema: the highest value, signed. Nothing, as there
    is before the first operand and in place of a null value, is below every number, 0 included."""
    number = lambda b: (bool(b), int.from_bytes(b, "little", signed=True))
    own = Operators().register_merge("highest", lambda have, operand, now: max(have, operand, key=number))
    db = opened(spark, "custom", schema=Schema().edit().set_operator(0, "highest").commit(), operators=own)
    add(db, stored_events(spark, sf_dir).withColumn("v", F.coalesce("v", F.lit(b""))))
    db.compact()
    h = F.hex("c0")
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return db.view().select("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key"), F.conv(turned, 16, -10).cast("bigint").alias("highest"))


@query("SELECT CAST(n_regionkey AS INT) AS bucket, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN n_name || '+' || n_name END AS twice FROM nation")
def kv_write_batch(spark, sf_dir):
    """Puts of a batch, merges, and deletes of one column, one call at a time, through the buffer."""
    db = Database.open(spark, new_store(spark, "batch"), Config(num_columns=2, total_buckets=16, buffer_rows=7))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", "n_name").collect()  # a fixed table of 25 rows
    for region in sorted({r.n_regionkey for r in nations}):
        own = [(r.n_name.encode(), r.n_name.encode()) for r in nations if r.n_regionkey == region]
        db.put_batch(int(region), 0, own)
        db.put_batch(int(region), 1, own)
    batch = db.new_batch()
    for r in nations:
        batch.merge(int(r.n_regionkey), r.n_name.encode(), 1, b"+" + r.n_name.encode())
        if r.n_nationkey % 3 == 0:
            batch.delete(int(r.n_regionkey), r.n_name.encode(), 1)
    db.write(batch, durable=True)
    return db.view().select("bucket", F.decode("c0", "UTF-8").alias("name"), F.decode("c1", "UTF-8").alias("twice"))


@query(WITH + ", q AS (SELECT bucket, key, string_agg(event_type, '' ORDER BY seq) AS v, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM log WHERE event_type <> 'error' GROUP BY bucket, key) SELECT bucket, key, v, CASE WHEN n <= 2 THEN 'first' ELSE 'second' END AS turn FROM q WHERE n <= 5")
def pq_store_poll(spark, sf_dir):
    """Two polls of a stored queue: two entries a bucket, then the next three; offers below the cursor in between stay unseen."""
    db = opened(spark, "queue")
    q = db.new_queue("tasks")
    log = event_log(spark, sf_dir).where("event_type <> 'error'")
    offered = log.select(F.col("seq"), "bucket", F.lit("tasks").alias("cf"), big_endian(F.col("key")).alias("key"), "col", F.lit("merge").alias("op"), F.encode("event_type", "UTF-8").alias("v"))
    add(db, offered)
    first = q.poll_frame(2)
    for b in range(16):
        q.offer(b, (0).to_bytes(8, "big"), b"late")
    second = q.poll_frame(3)
    out = first.withColumn("turn", F.lit("first")).unionByName(second.withColumn("turn", F.lit("second")))
    return out.select("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key"), F.decode("c0", "UTF-8").alias("v"), "turn")


@query(WITH + "SELECT * FROM view")
def stream_ingest_fold(spark, sf_dir):
    """A folder of mutations streamed into a store, a file a batch, with the stream run twice."""
    path = new_store(spark, "stream")
    db = Database.open(spark, f"{path}/store", Config(total_buckets=16), schema=counters())
    rows = stored_events(spark, sf_dir).withColumn("schema_v", F.lit(1))
    rows.repartition(4, "seq").write.parquet(f"{path}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    for _ in range(2):
        ingest(spark, f"{path}/in", schema, db.store, f"{path}/checkpoint", 1)
    return shown(db.view(TYPED))


@query(WITH + ", q AS (SELECT bucket, key, string_agg(event_type, '' ORDER BY seq) AS v, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM log GROUP BY bucket, key) SELECT bucket, key, v FROM q WHERE n <= 2")
def stream_pq(spark, sf_dir):
    """A stream of offers into a stored queue, and what a poll then takes."""
    path = new_store(spark, "stream-queue")
    db = Database.open(spark, f"{path}/store", Config(total_buckets=16))
    q = db.new_queue("tasks")
    rows = event_log(spark, sf_dir).select("seq", "bucket", "key", "event_type")
    rows.repartition(4, "seq").write.parquet(f"{path}/in")
    as_offers = lambda batch: batch.select("seq", "bucket", big_endian(F.col("key")).alias("key"), F.encode("event_type", "UTF-8").alias("v"))
    offers(spark, f"{path}/in", "seq long, bucket int, key long, event_type string", q, f"{path}/checkpoint", as_offers, 1)
    return q.poll_frame(2).select("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key"), F.decode("c0", "UTF-8").alias("v"))


@query(WITH + ", p AS (SELECT *, row_number() OVER (ORDER BY key) AS n FROM view WHERE bucket = 5) SELECT CAST((n - 1) // 3 AS INT) AS page, CAST(key AS BIGINT) AS key, total, max(n) OVER () > 3 * ((n - 1) // 3 + 1) AS has_more FROM p")
def kv_inspect_pages(spark, sf_dir):
    """All pages of a bucket, three rows each, through the inspector."""
    db = SingleDatabase.open(spark, new_store(spark, "inspect"), Config(total_buckets=16), schema=counters())
    add(db, stored_events(spark, sf_dir))
    db.global_snapshot()
    raw, out = lambda x: base64.b64decode(x["b64"]), []
    for page, got in enumerate(Inspector(db.reader()).pages(5, limit=3)):
        out += [(page, int.from_bytes(raw(i["key"]), "big"), int.from_bytes(raw(i["columns"][0]), "little"), got["has_more"]) for i in got["items"]]
    return spark.createDataFrame(out, "page int, key long, total long, has_more boolean")


@query("SELECT name, CAST(value AS DOUBLE) AS value FROM (SELECT 'rows' AS name, count(*) AS value FROM events UNION ALL SELECT 'last_seq', max(event_id) - 1 FROM events UNION ALL SELECT 'segments', 2 UNION ALL SELECT 'snapshots', 1)")
def kv_metrics(spark, sf_dir):
    """Measures of a store of two segments and a snapshot."""
    db, ops = opened(spark, "metrics"), stored_events(spark, sf_dir)
    add(db, ops.where("seq < 1000"))
    add(db, ops.where("seq >= 1000"))
    db.snapshot()
    wanted: list[Sample] = [s for s in db.metrics() if s.name in ("rows", "last_seq", "segments", "snapshots")]
    return samples_frame(spark, wanted).select("name", "value")


@query("SELECT * FROM (VALUES ('a', 0, 5, 'owned'), ('b', 6, 9, 'owned'), ('c', 4, 7, 'refused'), ('c', 10, 15, 'owned')) t(db_id, lo, hi, state)")
def kv_governance(spark, sf_dir):
    """Owners that register in turn; one overlaps others and is refused, then takes what is left."""
    g, out = Governance(spark, new_store(spark, "governance")), []
    for name, lo, hi in (("a", 0, 5), ("b", 6, 9), ("c", 4, 7), ("c", 10, 15)):
        try:
            g.register(name, [(lo, hi)])
            out.append((name, lo, hi, "owned"))
        except Conflict:
            out.append((name, lo, hi, "refused"))
    return spark.createDataFrame(out, "db_id string, lo int, hi int, state string")


@query(WITH + "SELECT bucket, key, string_agg(event_type, '' ORDER BY seq) AS joined FROM live GROUP BY bucket, key")
def kv_store_value_log(spark, sf_dir):
    """Values of more than five bytes lie beside the log and come back only where their versions count."""
    db = opened(spark, "far", Config(total_buckets=16, value_log_threshold=5), schema=Schema())
    ops = stored_events(spark, sf_dir).drop("v").join(event_log(spark, sf_dir).select((F.col("seq") - 1).alias("seq"), F.encode("event_type", "UTF-8").alias("v")), "seq")
    add(db, ops.where("seq < 4000"))
    db.compact()
    add(db, ops.where("seq >= 4000"))
    return db.view().select("bucket", from_big_endian(F.col("key")).cast("bigint").alias("key"), F.decode("c0", "UTF-8").alias("joined"))


@query(WITH + "SELECT *, TRUE AS few FROM view")
def kv_store_maintained(spark, sf_dir):
    """Twelve segments, of which the policy leaves few."""
    db, ops = opened(spark, "maintained", Config(total_buckets=16, max_deltas=3, compaction_policy="min_overlap")), stored_events(spark, sf_dir)
    for lo in range(0, 12):
        add(db, ops.where(f"seq >= {lo * 800} and seq < {(lo + 1) * 800}"))
    add(db, ops.where("seq >= 9600"))
    db.maintain()
    few = sum(not s.base for s in db.manifest().segments) <= 3
    return shown(db.view(TYPED)).withColumn("few", F.lit(few))


@query(WITH + "SELECT * FROM view WHERE bucket = 3")
def kv_store_resume(spark, sf_dir):
    """One bucket written call by call, resumed by another object, and read in blocks."""
    db = opened(spark, "resume")
    rows = stored_events(spark, sf_dir).where("bucket = 3").orderBy("seq").toLocalIterator()  # one bucket, call by call
    with db.writer() as w:
        for r in rows:
            w.delete(3, bytes(r.key), 0) if r.op == "delete" else getattr(w, r.op)(3, bytes(r.key), 0, bytes(r.v))
    again = Database.resume(spark, db.path, db.config)
    found = [(3, int.from_bytes(k, "big"), int.from_bytes(c[0], "little")) for block, _ in again.blocks(3, size=4) for k, c in block]
    return spark.createDataFrame(found, "bucket int, key long, total long")


@query("SELECT id, retained, rows FROM (VALUES (0, TRUE, 100), (3, FALSE, 400), (4, FALSE, 500)) t(id, retained, rows)")
def kv_snapshot_lifecycle(spark, sf_dir):
    """Five snapshots, of which one is retained, retention keeps three others, and one is expired by hand."""
    db, ops = opened(spark, "lifecycle", Config(total_buckets=16, snapshot_retention=3)), stored_events(spark, sf_dir)
    for i in range(5):
        add(db, ops.where(f"seq >= {100 * i} and seq < {100 * i + 100}"))
        db.snapshot()
        if i == 0:
            db.retain_snapshot(0)
    db.expire_snapshot(0)
    db.expire_snapshot(2)
    db.vacuum()
    out = [(s.id, s.retained, db.at_snapshot(s.id).log("default").count()) for s in db.list_snapshots()]
    return spark.createDataFrame(out, "id int, retained boolean, rows int")


@query("""SELECT * FROM (VALUES ('default', 0, TRUE, NULL, 0, 'bytes', NULL, '{"unit": "m"}'), ('default', 0, TRUE, NULL, 1, 'u64_counter', NULL, NULL), ('lists', 1, FALSE, NULL, 0, 'list', '{"cap": 3, "keep": "last"}', NULL),
('tasks', 2, TRUE, '{"kind": "priority_queue"}', 0, 'bytes', NULL, NULL)) t(family, id, value_has_ttl, family_metadata, col, operator, made_with, notes)""")
def kv_schema_registry(spark, sf_dir):
    """The stored schema as a table, after commits that add, drop and describe columns and families."""
    db = opened(spark, "registry")
    db.commit(db.edit_schema().add_column(0, "u32_counter").add_column(2, "u64_counter"))
    db.commit(db.edit_schema().delete_column(1).delete_column(0))
    edit = db.edit_schema().ensure_family("lists", value_has_ttl=False).add_column(0, "list", family="lists", cap=3, keep="last")
    db.commit(edit.add_column(0).set_column_metadata(0, {"unit": "m"}))
    db.new_queue("tasks")
    return schema_frame(spark, Database.resume(spark, db.path, db.config).current_schema())


@query(WITH + "SELECT bucket, key, string_agg(props, '|' ORDER BY seq) AS items, CASE WHEN bucket < 6 OR (bucket = 6 AND key <= 40) THEN 'before' ELSE 'after' END AS part FROM live GROUP BY bucket, key")
def kv_typed_scan_plan(spark, sf_dir):
    """Lists read through a typed plan over a global snapshot, its one split parted and sent as JSON."""
    db = TypedDatabase(SingleDatabase.open(spark, new_store(spark, "typed-plan"), Config(total_buckets=16), schema=Schema(0, {})))
    db.edit().add_list_column(0, ListType()).commit()
    add(db.raw, list_ops(spark, sf_dir))
    snapshot = db.raw.global_snapshot()
    halves = TypedScanPlan(snapshot).splits()[0].split_after(6, (40).to_bytes(8, "big"))
    parts = [joined_lists(TypedScanSplit.from_json(h.to_json()).scanner(spark, db.raw.config)).withColumn("part", F.lit(n)) for n, h in zip(("before", "after"), halves)]
    return parts[0].unionByName(parts[1])


@query(WITH + "SELECT bucket, key, string_agg(props, '|' ORDER BY seq) AS items FROM live WHERE bucket IN (2, 9) GROUP BY bucket, key")
def kv_typed_reader(spark, sf_dir):
    """Two buckets through a typed reader that follows CURRENT."""
    db = TypedDatabase(SingleDatabase.open(spark, new_store(spark, "typed-reader"), Config(total_buckets=16), schema=Schema(0, {})))
    db.edit().add_list_column(0, ListType()).commit()
    ops = list_ops(spark, sf_dir)
    add(db.raw, ops.where("seq < 100"))
    db.raw.global_snapshot()
    reader = TypedReader(db.raw.reader())
    add(db.raw, ops.where("seq >= 100"))
    db.raw.global_snapshot()
    reader.refresh()
    return joined_lists(reader.scan(2).unionByName(reader.scan(9)))


@query("SELECT CAST(r_regionkey AS INT) AS bucket, r_name AS name, r_name || ',' || upper(r_name) || '!' AS list, CASE WHEN r_regionkey % 2 = 1 THEN r_name END AS plain FROM region")
def kv_typed_batch(spark, sf_dir):
    """Typed puts, merges and deletes of a batch, encoded lists, and a read of single rows."""
    db = TypedDatabase.open(spark, new_store(spark, "typed-batch"), Config(total_buckets=16))
    db.edit().add_list_column(1, ListType(2)).commit()
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()  # a fixed table of five rows
    batch = db.new_batch()
    for r in regions:
        key = r.r_name.encode()
        batch.put(r.r_regionkey, key, 0, key).put(r.r_regionkey, key, 1, [key])
        if r.r_regionkey % 2 == 0:
            batch.delete(r.r_regionkey, key, 0)
    db.write(batch)
    for r in regions:
        db.merge_encoded_list(r.r_regionkey, r.r_name.encode(), 1, ListType(2).encode([r.r_name.upper().encode() + b"!", b"beyond the cap"]))
    found = [(int(r.r_regionkey), r.r_name, *db.get(r.r_regionkey, r.r_name.encode())) for r in regions]
    rows = [(b, n, b",".join(items).decode(), plain and plain.decode()) for b, n, plain, items in found]
    return spark.createDataFrame(rows, "bucket int, name string, list string, plain string")
