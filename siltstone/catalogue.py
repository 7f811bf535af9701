"""The engine's queries over the test tables, each with its SQL.

The log of most queries is derived from ``events``: seq is event_id, key user_id, bucket
user_id mod 16; a signup is a put, an error a delete, anything else a merge; v is the value in
hundredths; a purchase expires 500 ticks after its seq.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codec import big_endian, from_big_endian, little_endian
from .functions.merge import KEYS, Concat, Counter, Custom, Latest, ListAppend, StoredList, capped_lists
from .operators import queue, ranges, reads, resolve, snapshots
from .operators.schema import Schema
from .plans.scan import ScanPlan, ScanSplit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = 5000

WITH = """
WITH log AS (
  SELECT event_id AS seq, CAST(user_id % 16 AS INT) AS bucket, user_id AS key, event_type, props, ts, value,
         CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op,
         CAST(round(value * 100) AS BIGINT) AS v, CASE WHEN event_type = 'purchase' THEN event_id + 500 END AS exp FROM events),
floors AS (SELECT key, max(seq) FILTER (op <> 'merge') AS f FROM log GROUP BY key),
live AS (SELECT log.* FROM log JOIN floors USING (key) WHERE op <> 'delete' AND (f IS NULL OR seq >= f)),
view AS (SELECT bucket, key, CAST(sum(v) AS BIGINT) AS total FROM live GROUP BY bucket, key)
"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "error", "delete").otherwise("merge")
    return e.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 16).cast("int").alias("bucket"), F.lit("default").alias("cf"), F.col("user_id").alias("key"), F.lit(0).alias("col"),
        op.alias("op"), F.round(F.col("value") * 100).cast("bigint").alias("v"), F.when(F.col("event_type") == "purchase", F.col("event_id") + 500).alias("exp"), "event_type", "props",
    )


def totals(log: DataFrame, **options) -> DataFrame:
    found = resolve.rows(log, {"total": (0, Counter(), "v")}, **options)
    return found.select("bucket", "key", F.col("total").cast("bigint").alias("total"))


def kept_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(event_log(spark, sf_dir)).withColumn("cf", F.lit("default"))


OUT = ["bucket", "key", "total"]


@query(WITH + "SELECT bucket, key, max_by(v, seq) AS v FROM log JOIN floors USING (key) WHERE seq = f AND op = 'put' GROUP BY bucket, key")
def kv_fold_put_delete(spark, sf_dir):
    log = event_log(spark, sf_dir).where("op <> 'merge'")
    return resolve.rows(log, {"v": (0, Latest(), "v")}).select("bucket", "key", "v")


@query(WITH + "SELECT * FROM view")
def kv_fold_counter_u64(spark, sf_dir):
    return totals(event_log(spark, sf_dir))


@query(WITH + "SELECT bucket, key, CAST(sum(v) AS BIGINT) AS total FROM live GROUP BY bucket, key HAVING sum(v) <= 4294967295")
def kv_fold_counter_u32(spark, sf_dir):
    found = resolve.rows(event_log(spark, sf_dir), {"total": (0, Counter("u32_counter", 32), "v")})
    return found.select("bucket", "key", F.col("total").cast("bigint").alias("total"))


@query(WITH + "SELECT bucket, key, string_agg(event_type, '' ORDER BY seq) AS joined FROM live GROUP BY bucket, key")
def kv_fold_concat(spark, sf_dir):
    return resolve.rows(event_log(spark, sf_dir), {"joined": (0, Concat(text=True), "event_type")}).select("bucket", "key", "joined")


def _list(spark, sf_dir, op: ListAppend) -> DataFrame:
    live = resolve.live(event_log(spark, sf_dir)).select(*KEYS, "seq", F.col("props").alias("v"))
    found = capped_lists(live, op) if op.cap is not None else live.groupBy(*KEYS).agg(op.value(F.col("v"), F.col("seq")).alias("v"))
    return found.select("bucket", "key", F.array_join("v", "|").alias("items"))


@query(WITH + "SELECT bucket, key, string_agg(props, '|' ORDER BY seq) AS items FROM live GROUP BY bucket, key")
def kv_list_append(spark, sf_dir):
    return _list(spark, sf_dir, ListAppend())


@query(WITH + "SELECT bucket, key, array_to_string((list(props ORDER BY seq))[1:3], '|') AS items FROM live GROUP BY bucket, key")
def kv_list_first3(spark, sf_dir):
    return _list(spark, sf_dir, ListAppend(cap=3))


@query(WITH + "SELECT bucket, key, array_to_string((list(props ORDER BY seq))[-3:], '|') AS items FROM live GROUP BY bucket, key")
def kv_list_last3(spark, sf_dir):
    return _list(spark, sf_dir, ListAppend(cap=3, keep="last"))


@query(WITH + f"SELECT bucket, key, array_to_string((list(props ORDER BY seq))[1:3], '|') AS items FROM live WHERE exp IS NULL OR exp > {NOW} GROUP BY bucket, key")
def kv_list_element_ttl(spark, sf_dir):
    """Each element has an expiry of its own; rows have none."""
    log = event_log(spark, sf_dir).withColumn("element", F.array(F.struct(F.col("props").alias("v"), "exp")))
    found = resolve.rows(log, {"items": (0, StoredList(cap=3, element_ttl=True).at(NOW), "element")})
    return found.where(F.size("items") > 0).select("bucket", "key", F.array_join(F.transform("items", lambda e: e["v"]), "|").alias("items"))


def three_columns(spark, sf_dir) -> DataFrame:
    """The log dealt to three columns by seq: a counter, a joined text and the newest value."""
    return event_log(spark, sf_dir).withColumn("col", (F.col("seq") % 3).cast("int"))


COLUMNS = {"total": (0, Counter(), "v"), "joined": (1, Concat(text=True), "event_type"), "newest": (2, Latest(), "v")}
THREE = """
WITH log AS (
  SELECT event_id AS seq, CAST(user_id % 16 AS INT) AS bucket, user_id AS key, event_id % 3 AS col, event_type,
         CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op, CAST(round(value * 100) AS BIGINT) AS v FROM events),
floors AS (SELECT key, col, max(seq) FILTER (op <> 'merge') AS f FROM log GROUP BY key, col),
live AS (SELECT log.* FROM log JOIN floors USING (key, col) WHERE op <> 'delete' AND (f IS NULL OR seq >= f))
"""


@query(THREE + """SELECT bucket, key, CAST(sum(v) FILTER (col = 0) AS BIGINT) AS total, string_agg(event_type, '' ORDER BY seq) FILTER (col = 1) AS joined,
       max_by(v, seq) FILTER (col = 2) AS newest FROM live GROUP BY bucket, key""")
def kv_multi_column_row(spark, sf_dir):
    found = resolve.rows(three_columns(spark, sf_dir), COLUMNS)
    return found.select("bucket", "key", F.col("total").cast("bigint").alias("total"), "joined", "newest")


@query(THREE + "SELECT bucket, key, max_by(v, seq) AS newest FROM live WHERE col = 2 GROUP BY bucket, key")
def kv_project(spark, sf_dir):
    return resolve.rows(three_columns(spark, sf_dir), {"newest": COLUMNS["newest"]}).select("bucket", "key", "newest")


@query(WITH + "SELECT * FROM view WHERE key = 7")
def kv_get(spark, sf_dir):
    log = event_log(spark, sf_dir).where((F.col("bucket") == 7) & (F.col("key") == 7))  # one key's versions are read
    return reads.get(totals(log).withColumn("cf", F.lit("default")), 7, 7).select(*OUT)


@query(WITH + "SELECT w.pos, w.bucket, w.key, view.total FROM (VALUES (0, 3, 3), (1, 5, 5), (2, 3, 3), (3, 1, 999999937), (4, 1, 17)) w(pos, bucket, key) LEFT JOIN view ON view.key = w.key AND view.bucket = w.bucket")
def kv_multi_get(spark, sf_dir):
    wanted = spark.createDataFrame([(0, 3, 3), (1, 5, 5), (2, 3, 3), (3, 1, 999999937), (4, 1, 17)], "pos int, bucket int, key long")
    log = event_log(spark, sf_dir).join(wanted.select("bucket", "key").distinct(), ["bucket", "key"], "left_semi")  # only their versions are resolved
    return reads.multi_get(totals(log).withColumn("cf", F.lit("default")), wanted).select("pos", "bucket", F.col("key").cast("int").alias("key"), "total")


@query(WITH + "SELECT * FROM view WHERE key >= 20 AND key < 60")
def kv_scan_range(spark, sf_dir):
    log = event_log(spark, sf_dir).where(reads.between(20, 60))
    return reads.scan(totals(log).withColumn("cf", F.lit("default")), 20, 60).select(*OUT)


@query(WITH + "SELECT * FROM view WHERE bucket = 3 AND key >= 20")
def kv_scan_open(spark, sf_dir):
    return reads.scan(kept_view(spark, sf_dir), 20, None, bucket=3).select(*OUT)


@query(WITH + "SELECT bucket, key, total FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM view) WHERE n <= 3")
def kv_scan_limit(spark, sf_dir):
    return reads.first_rows(kept_view(spark, sf_dir), 3).select(*OUT)


@query("""WITH p AS (SELECT url, page_id FROM pages WHERE starts_with(url, 'https://') AND url > 'https://m' ORDER BY url, page_id), k AS (SELECT url, min(page_id) AS page_id FROM p GROUP BY url),
q AS (SELECT *, row_number() OVER (ORDER BY url) AS n, count(*) OVER () AS c FROM k)
SELECT url, page_id, c > 20 AS has_more, CASE WHEN c > 20 THEN max(url) OVER () END AS next_start_after FROM q WHERE n <= 20""")
def kv_prefix_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return reads.prefix_page(pages, "https://", "https://m", 20, "url")


@query(WITH + "SELECT * FROM view")
def kv_batch_fold(spark, sf_dir):
    return totals(resolve.fold_batches(event_log(spark, sf_dir), 100))


TTL = f"""
WITH log AS (
  SELECT event_id AS seq, CAST(user_id % 16 AS INT) AS bucket, user_id AS key, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op,
         CAST(round(value * 100) AS BIGINT) AS v, CASE WHEN event_type = 'purchase' THEN event_id + 500 END AS exp FROM events WHERE event_type <> 'purchase' OR event_id + 500 > {NOW}),
floors AS (SELECT key, max(seq) FILTER (op <> 'merge') AS f FROM log GROUP BY key),
live AS (SELECT log.* FROM log JOIN floors USING (key) WHERE op <> 'delete' AND (f IS NULL OR seq >= f))
"""


@query(TTL + "SELECT bucket, key, CAST(sum(v) AS BIGINT) AS total FROM live GROUP BY bucket, key")
def kv_ttl_scan(spark, sf_dir):
    return totals(event_log(spark, sf_dir), now=NOW)


@query(WITH + "SELECT * FROM view")
def kv_ttl_family_off(spark, sf_dir):
    """Expiries that were written count for nothing in a family without TTL."""
    schema = Schema().edit().set_operator(0, "u64_counter").set_family_options(value_has_ttl=False).commit()
    log = event_log(spark, sf_dir).withColumn("v", little_endian(F.col("v"), 8)).withColumn("schema_v", F.lit(schema.version))
    return resolve.stored_rows(log, schema, "default", now=NOW, raw=False).select("bucket", "key", F.col("c0").cast("bigint").alias("total"))


@query(TTL + "SELECT bucket, key, arg_max_null(exp, seq) AS exp FROM live GROUP BY bucket, key")
def kv_row_expiry(spark, sf_dir):
    return resolve.expiry(event_log(spark, sf_dir), NOW).select("bucket", "key", "exp")


@query(WITH.replace("FROM events)", "FROM events WHERE event_id <= 4000)") + "SELECT * FROM view")
def kv_snapshot_at(spark, sf_dir):
    return totals(event_log(spark, sf_dir), at=4000)


@query(WITH + "SELECT bucket, key, count(*) AS versions FROM log WHERE seq > 2000 AND seq <= 4000 GROUP BY bucket, key")
def kv_snapshot_diff(spark, sf_dir):
    return snapshots.changed_keys(event_log(spark, sf_dir), 2000, 4000).select("bucket", "key", "versions")


@query("WITH s AS (SELECT DISTINCT event_id // 1000 AS id FROM events) SELECT id, id % 4 = 1 AS retained, (row_number() OVER (ORDER BY id DESC) <= 2 OR id % 4 = 1 OR id = 2) AS kept FROM s")
def kv_retention(spark, sf_dir):
    ids = event_log(spark, sf_dir).select(F.floor(F.col("seq") / 1000).cast("bigint").alias("id")).distinct()
    return snapshots.retained(ids.withColumn("retained", F.col("id") % 4 == 1), 2, 2)


SHARDS = WITH + ", shards AS (SELECT CAST(bucket // 4 AS BIGINT) AS shard, min(bucket) AS lo, max(bucket) AS hi, max(seq) AS last_seq, count(*) AS versions, max(seq) AS time FROM log GROUP BY bucket // 4)\n"


@query(SHARDS + "SELECT * FROM shards")
def kv_scan_plan(spark, sf_dir):
    return snapshots.shard_descriptors(event_log(spark, sf_dir).withColumn("time", F.col("seq")), 4)


@query(SHARDS + "SELECT count(*) AS shards, CAST(sum(versions) AS BIGINT) AS versions, min(time) AS watermark, CAST(sum(hi - lo + 1) AS BIGINT) AS buckets FROM shards")
def kv_global_manifest(spark, sf_dir):
    return snapshots.global_snapshot(snapshots.shard_descriptors(event_log(spark, sf_dir).withColumn("time", F.col("seq")), 4))


@query("""WITH f AS (SELECT DISTINCT o_orderkey % 4 AS shard, o_orderstatus AS name, CASE WHEN o_orderkey % 4 = 3 THEN 9 ELSE ascii(o_orderstatus) END AS id FROM orders)
SELECT 'name' AS kind, name AS what FROM f GROUP BY name HAVING count(DISTINCT id) > 1 UNION ALL SELECT 'id', CAST(id AS VARCHAR) FROM f GROUP BY id HAVING count(DISTINCT name) > 1""")
def kv_manifest_conflicts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    f = o.select((F.col("o_orderkey") % 4).alias("shard"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 4 == 3, 9).otherwise(F.ascii("o_orderstatus")).alias("id")).distinct()
    return snapshots.family_conflicts(f)


@query("SELECT o_orderkey AS key, o_orderstatus AS c0, CASE WHEN o_orderkey % 2 = 0 THEN 'default' ELSE o_orderstatus || '!' END AS c1, o_orderpriority AS c2 FROM orders")
def kv_schema_add_default(spark, sf_dir):
    base = Schema().edit().set_operator(1, "bytes").commit()
    schema = base.edit().add_column(1, default="default").commit(base)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    old = schema.read_as("default", base.version, [F.col("o_orderstatus"), F.col("o_orderpriority")])
    new = [F.col("o_orderstatus"), F.concat("o_orderstatus", F.lit("!")), F.col("o_orderpriority")]
    return o.select(F.col("o_orderkey").alias("key"), *[F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(b).alias(f"c{i}") for i, (a, b) in enumerate(zip(old, new))])


@query("SELECT o_orderkey AS key, o_orderpriority AS c0 FROM orders")
def kv_schema_drop(spark, sf_dir):
    base = Schema().edit().set_operator(1, "bytes").commit()
    schema = base.edit().delete_column(0).commit(base)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("key"), *[c.alias(f"c{i}") for i, c in enumerate(schema.read_as("default", base.version, [F.col("o_orderstatus"), F.col("o_orderpriority")]))])


@query(WITH + """, s(shard, lo, hi) AS (VALUES (0, 0, 3), (1, 3, 9), (2, 11, 15)), b AS (SELECT DISTINCT bucket FROM log), o AS (SELECT bucket, count(s.shard) AS owners, min(shard) AS shard FROM b LEFT JOIN s ON bucket BETWEEN lo AND hi GROUP BY bucket)
SELECT bucket, shard, owners, CASE WHEN owners = 0 THEN 'missing' WHEN owners > 1 THEN 'overlap' ELSE 'owned' END AS state FROM o""")
def kv_bucket_route(spark, sf_dir):
    shards = spark.createDataFrame([(0, 0, 3), (1, 3, 9), (2, 11, 15)], "shard int, lo int, hi int")
    return ranges.route(event_log(spark, sf_dir).select("bucket").distinct(), shards)


@query(WITH + "SELECT CASE WHEN bucket < 6 OR (bucket = 6 AND key <= 40) THEN 'before' ELSE 'after' END AS part, bucket, key, total FROM view WHERE bucket BETWEEN 4 AND 9")
def kv_split_after(spark, sf_dir):
    view = kept_view(spark, sf_dir)
    before, after = ScanPlan(((4, 9),)).splits()[0].split_after(6, 40)
    after = ScanSplit.from_json(after.to_json())
    return before.rows(view).select(F.lit("before").alias("part"), *OUT).unionByName(after.rows(view).select(F.lit("after").alias("part"), *OUT))


def _cursors(spark) -> DataFrame:
    return spark.createDataFrame([(b, 16 * 2 + b) for b in range(0, 16, 2)], "bucket int, cursor long")


ABOVE = WITH + ", above AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM view WHERE bucket % 2 = 1 OR key > 32 + bucket)\n"


@query(ABOVE + "SELECT bucket, key, total FROM above WHERE n <= 2")
def pq_peek_k(spark, sf_dir):
    return queue.peek(kept_view(spark, sf_dir), _cursors(spark), 2).select(*OUT)


@query(ABOVE + "SELECT bucket, max(key) AS cursor FROM above WHERE n <= 2 GROUP BY bucket")
def pq_poll_k(spark, sf_dir):
    return queue.poll(kept_view(spark, sf_dir), _cursors(spark), 2)[1].where("bucket is not null").join(kept_view(spark, sf_dir).select("bucket").distinct(), "bucket", "left_semi")


@query("SELECT CAST(b AS INT) AS bucket, CAST(greatest(CASE WHEN b % 2 = 0 THEN 32 + b END, CASE WHEN b % 3 = 0 THEN 40 END) AS BIGINT) AS cursor FROM range(16) t(b) WHERE b % 2 = 0 OR b % 3 = 0")
def pq_advance(spark, sf_dir):
    return queue.advance(_cursors(spark), spark.createDataFrame([(b, 40) for b in range(0, 16, 3)], "bucket int, cursor long"))


@query(WITH + "SELECT * FROM view WHERE bucket % 2 = 1 OR key > 32 + bucket")
def kv_truncation_cursor(spark, sf_dir):
    return totals(event_log(spark, sf_dir), cursors=_cursors(spark).withColumn("cf", F.lit("default")))


@query(WITH + "SELECT * FROM view WHERE bucket BETWEEN 0 AND 4 OR bucket BETWEEN 9 AND 15")
def kv_shrink(spark, sf_dir):
    return ranges.in_ranges(kept_view(spark, sf_dir), ranges.shrink([(0, 15)], [(5, 8)])).select(*OUT)


@query(WITH + "SELECT * FROM view WHERE bucket BETWEEN 0 AND 7 OR bucket IN (10, 11)")
def kv_expand(spark, sf_dir):
    return ranges.in_ranges(kept_view(spark, sf_dir), ranges.expand([(0, 7)], [(8, 15)], [(10, 11)])).select(*OUT)


@query("SELECT CAST(a AS INT) AS lo, CAST(b AS INT) AS hi FROM (VALUES (0, 1), (5, 6), (9, 9)) t(a, b)")
def range_subtract(spark, sf_dir):
    return spark.createDataFrame(ranges.subtract([(0, 6), (8, 9)], [(2, 4), (8, 8)]), "lo int, hi int")


@query("SELECT CAST(a AS INT) AS lo, CAST(b AS INT) AS hi FROM (VALUES (0, 6), (8, 9)) t(a, b)")
def range_normalize(spark, sf_dir):
    return spark.createDataFrame(ranges.normalise([(8, 9), (3, 6), (0, 2)]), "lo int, hi int")


@query(WITH + "SELECT * FROM view")
def kv_compact_equiv(spark, sf_dir):
    log = event_log(spark, sf_dir)
    base = resolve.fold_batches(log.where("seq <= 5000"), 1_000_000)
    return totals(base.unionByName(log.where("seq > 5000").select(base.columns)))


@query(f"SELECT event_id // 100 AS file, bool_and(event_type = 'purchase' AND event_id + 500 <= {NOW}) AS expired, max(user_id) <= 40 AS truncated FROM events GROUP BY event_id // 100")
def kv_file_prune(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("part", F.floor(F.col("seq") / 100).cast("bigint")).withColumn("bucket", F.lit(0))
    lasting = F.count(F.when(F.col("exp").isNull() | (F.col("op") == "delete"), 1)).alias("lasting")
    stats = log.groupBy("part", "bucket", "cf").agg(F.count("*").alias("rows"), lasting, F.max("exp").alias("last_exp"), F.max("key").alias("hi"))
    cursors = spark.createDataFrame([(0, "default", 40)], "bucket int, cf string, cursor long")
    return resolve.dead_parts(stats, NOW, cursors).select(F.col("part").alias("file"), "expired", "truncated")


@query(WITH + "SELECT bucket, key, max(v) AS highest FROM live GROUP BY bucket, key")
def kv_custom_operator(spark, sf_dir):
    """A merge operator of the caller's: the highest value."""
    highest = Custom("highest", lambda have, operand, now: max(have, operand))
    log = event_log(spark, sf_dir).withColumn("v", big_endian(F.col("v")))
    found = resolve.rows(log, {"highest": (0, highest, "v")})
    return found.select("bucket", "key", from_big_endian(F.col("highest")).cast("bigint").alias("highest"))
