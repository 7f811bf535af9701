"""K-d tree sharding in DataFrame functions alone: sizes of the shards are near equal.

A node that has to yield k leaves is cut along its widest dimension (largest size-weighted
variance of the coordinates, each scaled to the table's range) at the weighted quantile
floor(k/2)/k. The quantile is found by distributed histograms over a 52-bit order key (20 bits of
the coordinate, 32 bits of a hash of the id, so that ties of a hot value can be cut): the first pass
takes the variances and the top 10 bits of all dimensions at once, each later one refines by 12 bits.
Only nodes x dimensions x 1024 or nodes x 4096 sums reach the driver. All nodes of a level share each pass.

Defined cases: a null text has no bytes (size 8) and the checksum of the empty text; null
metadata takes coordinate 0; equal rows are ordered by the hash of their id and repeated ids fall
on one side; an empty table gives an empty result; fewer rows than shards leave shards empty;
very long texts count by their bytes alone;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

FIRST, STEP, AXIS_BITS, KEY_BITS = 10, 12, 20, 52
#: A cut is fine enough when its last histogram bucket holds less than this share of a shard.
TOLERANCE = 1e-3
#: Rows of a numbering group within a shard, on average.
SLOT_ROWS = 50_000


def coordinate(docs: DataFrame, name: str) -> Column:
    """Metadata as a number: strings by a hash, numbers by their logarithm."""
    if dict(docs.dtypes)[name] == "string":
        return F.coalesce(F.crc32(F.col(name).cast("binary")).cast("double"), F.lit(0.0))
    return F.coalesce(F.log2(1 + F.abs(F.col(name).cast("double"))), F.lit(0.0))


class Node:
    def __init__(self, leaves: int) -> None:
        self.leaves = leaves
        self.axis = self.cut_at = self.low = self.high = self.number = None

    def number_leaves(self, first: int = 0) -> int:
        if self.low is None:
            self.number = first
            return first + 1
        return self.high.number_leaves(self.low.number_leaves(first))

    def column(self, value) -> Column:
        """The tree as nested conditions; value: what a node without children gives."""
        if self.low is None:
            return value(self)
        return F.when(order_key(self.axis) <= F.lit(self.cut_at), self.low.column(value)).otherwise(self.high.column(value))


def order_key(axis: int) -> Column:
    return F.shiftleft(F.col(f"x{axis}"), 32) + F.col("tie")


def split_level(rows: DataFrame, root: Node, open_nodes: list[Node], axes: int, total: float, shards: int) -> None:
    """Cuts all open nodes, each at its weighted quantile."""
    places = {id(n): i for i, n in enumerate(open_nodes)}
    node = root.column(lambda n: F.lit(places.get(id(n), -1))).alias("node")
    base = rows.select("*", node).where("node >= 0")
    one = base.select("node", "w", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"x{a}").alias("x")) for a in range(axes)])).alias("d")).select("node", "w", "d.axis", "d.x")
    wx = F.col("w") * F.col("x").cast("double")
    parts: dict[tuple, list] = {}
    for r in one.groupBy("node", "axis", F.shiftright("x", AXIS_BITS - FIRST).alias("key")).agg(F.sum("w").alias("w"), F.sum(wx).alias("s"), F.sum(wx * F.col("x")).alias("q")).collect():
        parts.setdefault((r["node"], r["axis"]), []).append((r["key"], r["w"], r["s"], r["q"]))

    def spread(found: list) -> float:
        w, s, q = (sum(f[k] for f in found) for k in (1, 2, 3))
        return q / w - (s / w) ** 2

    goal, prefix, below, active, shift = {}, {}, {}, [], KEY_BITS - FIRST

    def settle(i: int, found: list) -> None:
        """Descends into the histogram's bucket that holds the quantile of node i, or cuts there."""
        at, w = None, 0.0
        for at, w in sorted(f[:2] for f in found):
            if below[i] + w >= goal[i]:
                break
            below[i] += w
        prefix[i] = at
        if shift and w > TOLERANCE * total / shards:
            active.append(i)
        else:  # the bucket goes whole to the side where it does least harm
            low = below[i] + w - goal[i] <= goal[i] - below[i]
            open_nodes[i].cut_at = ((at + 1) << shift) - 1 if low else (at << shift) - 1

    for i, n in enumerate(open_nodes):
        n.low, n.high = Node(n.leaves // 2), Node(n.leaves - n.leaves // 2)
        n.axis, n.cut_at = 0, -1
        if (i, 0) in parts:
            n.axis = max(range(axes), key=lambda a: spread(parts[(i, a)]))
            own = parts[(i, n.axis)]
            goal[i], below[i] = sum(f[1] for f in own) * n.low.leaves / n.leaves, 0.0
            settle(i, own)
    while active and shift > 0:
        step = min(STEP, shift)
        shift -= step
        key = F.lit(None).cast("bigint")
        inside = F.lit(False)
        for i in active:
            k = order_key(open_nodes[i].axis)
            key = F.when(F.col("node") == i, F.shiftright(k, shift)).otherwise(key)
            inside = inside | ((F.col("node") == i) & (F.shiftright(k, shift + step) == F.lit(prefix[i])))
        finer: dict[int, list] = {}
        for r in base.where(inside).groupBy("node", key.alias("key")).agg(F.sum("w").alias("w")).collect():
            finer.setdefault(r["node"], []).append((r["key"], r["w"]))
        turn, active = active, []
        for i in turn:
            settle(i, finer[i])


def kd_shards(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; law is bytes, so grown_shard is null."""
    names = [d for d in dimensions if d in docs.columns]
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(data) + 8).cast("bigint").alias("w"),
            F.crc32(data).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("tie"),
            *[coordinate(docs, d).alias(f"c{a}") for a, d in enumerate(names)],
        ),
        "metadata",
    )
    axes = len(names) or 1
    ends = rows.agg(F.sum("w").alias("total"), F.count("*").alias("n"), *[f(f"c{a}").alias(f"{k}{a}") for a in range(len(names)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    for a in range(axes):
        lo, hi = (ends[f"lo{a}"] or 0.0, ends[f"hi{a}"] or 0.0) if names else (0.0, 0.0)
        x = F.floor((F.col(f"c{a}") - lo) / (hi - lo) * ((1 << 20) - 1)).cast("bigint") if hi > lo else F.lit(0).cast("bigint")
        rows = rows.withColumn(f"x{a}", x)
    root = Node(shards)
    level = [root] if ends["n"] and shards > 1 else []
    while level:
        split_level(rows, root, level, axes, float(ends["total"]), shards)
        level = [c for n in level for c in (n.low, n.high) if c.leaves > 1]
    root.number_leaves()
    groups = max(1, ends["n"] // (shards * SLOT_ROWS))
    placed = cut(rows.select("doc_id", "w", "text_crc32", root.column(lambda n: F.lit(n.number)).alias("shard"), (F.col("tie") % groups).alias("part")), "shards")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("first"))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id"))
    slots = placed.withColumn("inner", inner).join(first, ["shard", "part"])
    return slots.select(
        "doc_id", F.col("w").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("inner") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
