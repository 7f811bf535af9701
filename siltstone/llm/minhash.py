"""b-bit MinHash near-duplicates: links of Jaccard similarity at or above a threshold.

1. Sets: distinct shingles of each whole text as 64-bit hashes. Texts with equal sets form a class
   at once, so that copies never meet in a bucket; only class representatives go on.
2. Signatures: ``rows * bands`` minima. Sets of up to SMALL shingles use that many independent
   hash functions; sets of LARGE or more use one permutation cut into as many bins, empty bins
   filled from others by a fixed walk. Sets between get both, so that every pair whose sizes allow
   the similarity shares a kind. Each band of minima is a bucket key; the low ``bits`` of the
   minima are kept packed.
3. Candidates: rounds over buckets that hold more than one component. A round compares members
   with a few hubs of the bucket, keeps pairs whose collision-corrected estimate, from bit counts,
   may reach the threshold, confirms these on the full sets and merges components. When hubs
   have had their rounds, the members that remain in different components of a bucket are compared
   block by block, all pairs that the estimate allows are confirmed where they are compared, and
   the links that join components are kept, so that no component is missed.
4. Components: alternating large-star and small-star joins; each node gets its smallest id.

Defined cases: null, empty or white-space texts have an empty set and link with nothing; fewer
words than a shingle make one shingle of all words; an empty table gives an empty result; rows
that repeat a doc_id are one document of that id (the union is not taken: each row is a set);
rows without a doc_id belong to the class of their set and link with nothing themselves; very long
texts are hashed whole; of equal sets the smallest doc_id stands for all; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_views, cut, hold_memory, id_bytes, prepare
from .components import connected_components

ROWS, BANDS, BITS = 5, 40, 2
MINIMA = ROWS * BANDS
SMALL, LARGE = 320, 256  # SMALL * 0.8 = LARGE: below a similarity of 0.8 the overlap is widened
LANES = -(-MINIMA * BITS // 64)
#: What the estimate may fall short of the threshold by, some four standard deviations.
MARGIN = 0.15
#: Bytes of full sets in a block of a bucket; two blocks are compared at once.
BLOCK_BYTES = 8 << 20
CACHED_WORDS = 700_000
_WORDS: dict[bytes, int] = {}
_DRAW = np.random.default_rng(20_021)
_FACTOR = _DRAW.integers(1, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 63, MINIMA, np.uint64)
_WALK = _DRAW.integers(0, MINIMA, (MINIMA, 64))
_EDGES = np.array([-(-(i << 64) // MINIMA) for i in range(1, MINIMA)], np.uint64)
SIGNED = "doc_id long, n_shingles long, set_key binary, signatures array<struct<kind:int,packed:array<long>,bands:array<long>>>"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, n: int) -> np.ndarray:
    """Distinct shingles of n words as sorted 64-bit hashes."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    get = _WORDS.get
    codes = list(map(get, words))
    if None in codes:
        if len(_WORDS) > CACHED_WORDS:
            _WORDS.clear()
        for i, w in enumerate(words):
            if codes[i] is None:
                codes[i] = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array(codes, np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j])
    return np.unique(out)


def minima(found: np.ndarray, kind: int) -> np.ndarray:
    if kind == 0:
        least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 512):
            part = found[at : at + 512]
            least = np.minimum(least, (part[None, :] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1))
        return mix(least)
    at = np.concatenate(([0], np.searchsorted(found, _EDGES)))
    full = np.diff(np.concatenate((at, [len(found)]))) > 0
    source = np.arange(MINIMA)
    empty = np.flatnonzero(~full)
    if len(empty):
        tries = full[_WALK[empty]]
        source[empty] = np.where(tries.any(axis=1), _WALK[empty, tries.argmax(axis=1)], np.flatnonzero(full)[0])
    return mix(found[at[source]] + source.astype(np.uint64))


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, in 64-bit lanes."""
    low = np.zeros(LANES * 64 // BITS, np.uint64)
    low[:MINIMA] = least & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(low.reshape(LANES, -1) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray, kind: int) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(kind)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def kinds(size: int, overlap: int) -> list[int]:
    return [k for k, fits in ((0, size <= SMALL), (1, size >= overlap)) if fits]


def signed(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    prepare(docs.sparkSession)
    overlap = min(LARGE, int(SMALL * threshold))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("shingles", _WORDS.clear)
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for data in batch.column(1).to_pylist():
                found = shingle_set(data, n)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                both = []
                for kind in kinds(len(found), overlap) if len(found) else ():
                    least = minima(found, kind)
                    both.append({"kind": kind, "packed": packed(least).view(np.int64), "bands": band_keys(least, kind).view(np.int64)})
                signatures.append(both)
            shape = pa.list_(pa.struct([("kind", pa.int32()), ("packed", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()), "signatures": pa.array(signatures, shape)})

    return id_bytes(docs).mapInArrow(sign, SIGNED)


def estimate(a: str, b: str) -> Column:
    """Similarity from packed signatures, corrected for the chance that unequal minima agree in their low bits."""
    unequal = F.lit(0)
    for lane in range(LANES):
        x = F.col(a)[lane].bitwiseXOR(F.col(b)[lane])
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(int.from_bytes(_low_bits().tobytes(), "little", signed=True))))
    chance = 0.5**BITS
    return (1 - unequal / F.lit(float(MINIMA)) - chance) / (1 - chance)


def _low_bits() -> np.ndarray:
    return np.bitwise_or.reduce(np.uint64(1) << np.arange(0, 64, BITS, dtype=np.uint64))


def similar(x: np.ndarray, y: np.ndarray, whole: int) -> bool:
    """Whether two sorted sets reach a similarity of whole / 100."""
    both = np.concatenate((x, y))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return len(x) > 0 and 100 * common >= whole * (len(x) + len(y) - common)


def spanning_links(node: np.ndarray, comp: np.ndarray, side: np.ndarray, lanes: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between the components of one block pair of a bucket, one fewer than it joins at most.

    Bit counts tell which pairs may be links; the full sets of those decide, unless links found
    before join their components already. side 0: a block against itself, 1 against 2 otherwise.
    """
    mask, chance, whole = _low_bits(), 0.5**BITS, round(threshold * 100)
    most = MINIMA * (1 - chance) * (1 - threshold + MARGIN)
    size = np.array([len(x) for x in sets])
    label = np.unique(comp, return_inverse=True)[1]
    out = []
    right = np.flatnonzero(side != 1)
    for i in np.flatnonzero(side != 2):
        ahead = right[right > i] if side[i] == 0 else right
        x = lanes[ahead] ^ lanes[i]
        folded = x
        for s in range(1, BITS):
            folded = folded | (x >> np.uint64(s))
        unequal = np.bitwise_count(folded & mask).sum(axis=1)
        fits = (unequal <= most) & (100 * np.minimum(size[ahead], size[i]) >= whole * np.maximum(size[ahead], size[i]))
        may = ahead[fits]
        for j in may[np.argsort(unequal[fits], kind="stable")].tolist():
            if label[j] != label[i] and similar(sets[i], sets[j], whole):
                out.append((max(node[i], node[j]), min(node[i], node[j])))
                label[label == label[j]] = label[i]
    return out


def shared_shingles(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    whole = round(threshold * 100)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("confirm")
        for batch in batches:
            keep = pa.array([similar(x, y, whole) for x, y in zip(byte_views(batch.column(2)), byte_views(batch.column(3)))], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    with_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("hv")), "v")
    with_u = with_v.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("hu")), "u")
    return with_u.select("u", "v", "hu", "hv").mapInArrow(confirm, "u long, v long")


def bucket_members(reps: DataFrame) -> DataFrame:
    """(key, kind, node, packed) of each bucket with two nodes or more."""
    one = reps.select(F.col("doc_id").alias("node"), F.explode("signatures").alias("s"))
    flat = one.select("node", F.col("s.kind").alias("kind"), F.explode("s.bands").alias("key"))
    shared = flat.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    kept = cut(flat.join(shared, "key"), "buckets")
    return kept.join(one.select("node", F.col("s.kind").alias("kind"), F.col("s.packed").alias("packed")), ["node", "kind"])


def full_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory("shingles", _WORDS.clear)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "hashes": pa.array([shingle_set(d, n).tobytes() for d in batch.column(1).to_pylist()], pa.binary())})

    wanted = id_bytes(docs).join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return wanted.mapInArrow(make, "node long, hashes binary")


def labelled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Members with the component of their node, of buckets that hold more than one component."""
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    named = members.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    still = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return named.join(still, "key")


def hub_pairs(members: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Each member with that hub of its buckets that it seems most like."""
    order = F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("h"), F.col("node").alias("hub"), F.col("packed").alias("hub_packed"), F.col("comp").alias("hub_comp"))
    hubs = members.groupBy("key").agg(F.min(order).alias("s")).select("key", "s.hub", "s.hub_packed", "s.hub_comp")
    close = members.join(hubs, "key").where("comp <> hub_comp").withColumn("like", estimate("packed", "hub_packed")).where(F.col("like") >= threshold - MARGIN)
    best = close.groupBy("node").agg(F.max(F.struct("like", (-F.col("hub")).alias("h"))).alias("s"))
    return best.select(F.greatest("node", -F.col("s.h")).alias("u"), F.least("node", -F.col("s.h")).alias("v")).distinct()


def block_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links across the components of a bucket, confirmed on full sets, after all its pairs were compared.

    Buckets with the same members are compared once. A bucket's members are dealt to blocks of
    about BLOCK_BYTES of sets by a hash and each pair of blocks is a task's group; a group's rows
    are fewer than its members, whatever the number of pairs.
    """
    same = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    full = cut(members.join(once, "key").join(sets, "node"), "compared")
    sizes = full.groupBy("key").agg(F.ceil(F.sum(F.octet_length("hashes")) / BLOCK_BYTES).cast("long").alias("blocks"))
    dealt = full.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = other.select(
        "node", "comp", "packed", "hashes", F.concat_ws(":", "key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )

    def compare(table: pa.Table) -> pa.Table:
        hold_memory("confirm")
        node, comp, side = (table[c].to_numpy() for c in ("node", "comp", "side"))
        lanes = np.array(table["packed"].to_pylist(), np.int64).view(np.uint64)
        found = spanning_links(node, comp, side, lanes, [x for c in table["hashes"].chunks for x in byte_views(c)], threshold)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return units.groupBy("unit").applyInArrow(compare, "u long, v long").distinct()


def links(docs: DataFrame, reps: DataFrame, n: int, threshold: float, hub_rounds: int = 2) -> DataFrame | None:
    """(node, component) of representatives that link with others."""
    members = cut(bucket_members(reps), "members")
    sets = cut(full_sets(docs, members, n), "sets")
    comps, edges = None, None
    for turn in range(hub_rounds + 1):
        now = cut(labelled(members, comps), "open")
        if now.isEmpty():
            break
        found = cut(shared_shingles(hub_pairs(now, threshold, turn), sets, threshold) if turn < hub_rounds else block_links(now, sets, threshold), "links")
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.unionByName(found)
        comps = connected_components(edges)
        # a component's own links are kept by its star, so that later rounds start from these
        edges = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return comps


def near_duplicates(docs: DataFrame, n: int = 2, threshold: float = 0.8) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id, kept."""
    rows = cut(signed(docs, n, threshold), "signed")
    classes = cut(rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size"), "classes")
    full = rows.where("n_shingles > 0").join(classes, "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = full.where("doc_id = rep").select("doc_id", "signatures")
    comps = links(docs, reps, n, threshold)
    narrow = rows.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    named = narrow.withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    if comps is None:
        named = named.withColumn("component", F.lit(None).cast("bigint"))
    else:
        named = named.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.coalesce("component", "rep").alias("component_id")
    return named.select("doc_id", "n_shingles", own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
classes AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
o AS (SELECT rep, len(sh) AS n, hash(x) AS x FROM (SELECT rep, sh, unnest(sh) AS x FROM classes)),
f AS (SELECT x, count(*) AS df FROM o GROUP BY x HAVING count(*) > 1),
r AS (SELECT o.rep, o.n, o.x, row_number() OVER (PARTITION BY o.rep ORDER BY coalesce(f.df, 1), o.x) AS k FROM o LEFT JOIN f ON o.x = f.x),
p AS (SELECT rep, n, x FROM r WHERE k <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.x = b.x AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
e AS (
  SELECT c.a, c.b FROM c JOIN classes x ON x.rep = c.a JOIN classes y ON y.rep = c.b
  WHERE 100 * len(list_intersect(x.sh, y.sh)) >= 80 * (len(x.sh) + len(y.sh) - len(list_intersect(x.sh, y.sh)))),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(a, b) AS (SELECT a, b FROM ee UNION SELECT walk.a, ee.b FROM walk JOIN ee ON walk.b = ee.a),
comp AS (SELECT a AS rep, least(a, min(b)) AS component_id FROM walk GROUP BY a),
members AS (SELECT s.doc_id, len(s.sh) AS n, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE c2.rep END AS rep FROM s LEFT JOIN classes c2 ON list_sort(s.sh) = c2.sh)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, coalesce(comp.component_id, m.rep) AS component_id, m.doc_id = coalesce(comp.component_id, m.rep) AS kept
FROM members m LEFT JOIN comp ON comp.rep = m.rep
"""
