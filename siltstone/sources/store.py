"""A stored log: segments of Parquet by family and bucket, and manifests that say which make a version.

A segment is written to a folder of its own; then one small file is renamed into place, which is
what makes the version exist. A crash before that leaves a folder that nothing names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidState
from ..operators.ranges import Range, in_ranges
from ..operators.reads import between
from ..operators.schema import Schema
from ..operators.writes import LOG
from .files import Folder, sealed, unsealed

ALL_BUCKETS: tuple[Range, ...] = ((0, 65535),)
STATS = "part string, bucket int, cf string, rows long, lasting long, last_exp long, lo binary, hi binary, first_seq long, last_seq long"


@dataclass(frozen=True)
class Span:
    """What a segment holds of one family: rows, those that never expire, the last expiry, and its keys' range (hex)."""

    rows: int
    lasting: int
    last_exp: int | None
    lo: str
    hi: str

    def may_hold(self, start: bytes | None, end: bytes | None, now: int | None) -> bool:
        if now is not None and not self.lasting and (self.last_exp or 0) <= now:
            return False
        return (start is None or bytes.fromhex(self.hi) >= start) and (end is None or bytes.fromhex(self.lo) < end)


@dataclass(frozen=True)
class Segment:
    """A folder of mutations. base: it holds the whole log up to its last seq. gone: parts (family, bucket) that go unread.
    home: another store whose folder it is; only: the buckets that are taken from it, all if none are named."""

    name: str
    first_seq: int
    last_seq: int
    base: bool = False
    spans: dict[str, Span] = field(default_factory=dict)
    gone: tuple[tuple[str, int], ...] = ()
    home: str = ""
    only: tuple[Range, ...] = ()
    #: How many of its values lie beside it.
    far: int = 0


@dataclass(frozen=True)
class Manifest:
    """A version of the store: its segments, the last seq, owned ranges, the schema, and batches of streams that are in it."""

    version: int
    segments: tuple[Segment, ...] = ()
    last_seq: int = -1
    ranges: tuple[Range, ...] = ALL_BUCKETS
    schema: str | None = None
    batches: dict[str, int] = field(default_factory=dict)
    id: str = ""

    def to_text(self) -> str:
        return sealed(asdict(self))

    @classmethod
    def from_text(cls, text: str) -> Manifest:
        d = unsealed(text, "manifest")
        segments = tuple(Segment(**s | {"spans": {k: Span(**x) for k, x in s["spans"].items()}, "gone": tuple(map(tuple, s["gone"])), "only": tuple(map(tuple, s["only"]))}) for s in d["segments"])
        return cls(**d | {"segments": segments, "ranges": tuple(map(tuple, d["ranges"]))})

    def read_schema(self) -> Schema:
        return Schema.from_json(self.schema) if self.schema else Schema()


def far_place(segment: Column) -> Column:
    """What finds a value that lies beside the log; a seq is one mutation's, and each of its columns has one value."""
    return F.concat_ws(":", segment, "seq", "col")


class LogStore:
    """Appends, replacements and reads of a log, each a version that its manifest alone describes."""

    def __init__(self, spark: SparkSession, path: str, schema: str = LOG, compression: str = "zstd", bloom_keys: int = 0, files: str = "parquet", far_bytes: int | None = None) -> None:
        """compression: of the files. bloom_keys: distinct keys a file that its Bloom filter of keys is made for; 0 for none.
        files: parquet or orc. far_bytes: larger values lie in files beside the log, which reads of other versions leave alone."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.compression, self.bloom_keys, self.files, self.far_bytes = compression, bloom_keys, files, far_bytes
        self.folder = Folder(spark, self.path)
        #: The newest version that was seen.
        self.loaded: Manifest | None = None

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names("manifest") if n.isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        found = self.versions()
        if not found:
            return None
        version = found[-1] if version is None else version
        if version not in found:
            raise InvalidState(f"no version {version}")
        if self.loaded is not None and self.loaded.version == version:  # a version never changes
            return self.loaded
        out = Manifest.from_text(self.folder.read(f"manifest/{version}"))
        if version == found[-1]:
            self.loaded = out
        return out

    def publish(self, new: Manifest) -> Manifest:
        """Makes a version exist; another that came first is a conflict."""
        self.folder.write(f"manifest/{new.version}", new.to_text())
        self.loaded = new
        return new

    def create(self, schema: Schema | None = None, ranges: Iterable[Range] = ALL_BUCKETS, name: str = "") -> Manifest:
        return self.publish(Manifest(1, ranges=tuple(ranges), schema=(schema or Schema()).to_json(), id=name or uuid.uuid4().hex))

    def write_segment(self, log: DataFrame, base: bool = False) -> Segment | None:
        """Mutations, sorted by key within their files, as a folder that no manifest names yet; none if there are none."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/segment={name}"
        rows = log.select(*[c.split()[0] for c in self.schema.split(", ")])
        far = F.lit(False) if self.far_bytes is None else F.coalesce((F.col("op") != "delete") & (F.octet_length("v") > self.far_bytes), F.lit(False))
        if self.far_bytes is not None:
            place = f"{self.path}/values/segment={name}"
            rows.where(far).select(far_place(F.lit(name)).alias("place"), F.col("v").alias("value")).write.option("compression", self.compression).format(self.files).save(place)
        stored = rows.withColumn("far", far).withColumn("v", F.when(~F.col("far"), F.col("v")))
        writer = stored.sortWithinPartitions("cf", "bucket", "key", "seq").write.format(self.files)
        writer = writer.option("compression", self.compression)
        if self.bloom_keys:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(self.bloom_keys))
        writer.partitionBy("cf", "bucket").save(folder)
        lasting = F.count(F.when(F.col("exp").isNull() | (F.col("op") == "delete"), 1))
        found = self._folders([Segment(name, 0, 0)]).groupBy("cf").agg(
            F.count("*").alias("rows"), lasting.alias("lasting"), F.max("exp").alias("last_exp"), F.hex(F.min("key")).alias("lo"), F.hex(F.max("key")).alias("hi"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.when(F.col("far"), 1)).alias("far")
        ).collect()  # fmt: skip  # a row a family
        if not found:
            self.folder.delete(f"data/segment={name}")
            self.folder.delete(f"values/segment={name}")
            return None
        spans = {r.cf: Span(r.rows, r.lasting, r.last_exp, r.lo, r.hi) for r in found}
        return Segment(name, min(r.first for r in found), max(r.last for r in found), base, spans, far=sum(r.far for r in found))

    def append(self, log: DataFrame, ranges: Iterable[Range] | None = None, batch: tuple[str, int] | None = None, schema: Schema | None = None, attempts: int = 5) -> Manifest:
        """A new version with these mutations. batch: a stream and its batch's number; one that is in already is not added again."""
        before = self.manifest() or Manifest(0, id=uuid.uuid4().hex, schema=Schema().to_json())
        if batch is not None and before.batches.get(batch[0], -1) >= batch[1]:
            return before
        new = self.write_segment(log)
        for left in reversed(range(attempts)):
            found = replace(
                before, version=before.version + 1, segments=(*before.segments, new) if new else before.segments, last_seq=max(before.last_seq, new.last_seq if new else -1),
                ranges=tuple(ranges) if ranges is not None else before.ranges, schema=schema.to_json() if schema else before.schema, batches=before.batches | dict([batch] if batch else []),
            )
            try:
                return self.publish(found)
            except Conflict:
                if not left:
                    raise
                before = self.manifest()
                if batch is not None and before.batches.get(batch[0], -1) >= batch[1]:
                    return before
        raise Conflict("no attempt left")

    def amend(self, change) -> Manifest:
        """A new version that differs as ``change`` (a function of manifests) says."""
        before = self.manifest()
        if before is None:
            raise InvalidState("the store has no version")
        return self.publish(replace(change(before), version=before.version + 1))

    def swap(self, old: Iterable[str], new: Segment | None, **more) -> Manifest:
        """A new version with one segment in the place of others, which later appends may have followed."""
        old = set(old)

        def change(m: Manifest) -> Manifest:
            if missing := old - {s.name for s in m.segments}:
                raise Conflict(f"{len(missing)} segments were replaced meanwhile")
            first = min((i for i, s in enumerate(m.segments) if s.name in old), default=0)
            kept = [s for s in m.segments if s.name not in old]
            return replace(m, segments=(*kept[:first], *([new] if new else []), *kept[first:]), **more)

        return self.amend(change)

    def _folders(self, segments: list[Segment]) -> DataFrame:
        """All rows of segments, by one reader for those of one store and choice of buckets."""
        groups: dict[tuple, list[Segment]] = {}
        for s in segments:
            groups.setdefault((s.home or self.path, s.only), []).append(s)
        out = None
        for (home, only), own in groups.items():
            reader = self.spark.read.schema(f"{self.schema}, far boolean, segment string").option("basePath", f"{home}/data").format(self.files)
            part = reader.load([f"{home}/data/segment={s.name}" for s in own])
            part = in_ranges(part, list(only)) if only else part
            out = part if out is None else out.unionByName(part)
        out = self.spark.createDataFrame([], f"{self.schema}, far boolean, segment string") if out is None else out
        for s in segments:
            for cf, bucket in s.gone:
                out = out.where(~((F.col("segment") == s.name) & (F.col("cf") == cf) & (F.col("bucket") == bucket)))
        return out

    def segments_for(self, found: Manifest, family: str | None = None, start: bytes | None = None, end: bytes | None = None, now: int | None = None) -> list[Segment]:
        """The segments that may hold versions which such a read sees."""
        spans = lambda s: s.spans.values() if family is None else [s.spans[family]] if family in s.spans else []
        return [s for s in found.segments if any(x.may_hold(start, end, now) for x in spans(s))]

    def fetched(self, rows: DataFrame, segments: Iterable[Segment]) -> DataFrame:
        """rows (with far and segment) of segments, with the values that lie beside the log in their place."""
        own = [s for s in segments if s.far]
        if own:
            values = None
            for home in {s.home or self.path for s in own}:
                paths = [f"{home}/values/segment={s.name}" for s in own if (s.home or self.path) == home]
                reader = self.spark.read.schema("place string, value binary, segment string").option("basePath", f"{home}/values").format(self.files)
                part = reader.load(paths).drop("segment")
                values = part if values is None else values.unionByName(part)
            near = rows.where("not far")
            rows = rows.where("far").join(values, "place").withColumn("v", F.col("value")).drop("value").unionByName(near)
        return rows.drop("far", "segment", "place")

    def read(
        self, version: int | None = None, family: str | None = None, start: bytes | None = None, end: bytes | None = None,
        now: int | None = None, ranges: Iterable[Range] | None = None, late: bool = False,
    ) -> DataFrame:
        """The log of a version, without the segments, parts and buckets that the read cannot see.

        late: where values lie beside the log, they are left there, and far, segment and place, which ``fetched`` needs, come along.
        """
        found = self.manifest(version)
        chosen = self.segments_for(found, family, start, end, now) if found else []
        out = self._folders(chosen)
        if family is not None:
            out = out.where(F.col("cf") == family)
        if start is not None or end is not None:
            out = out.where(between(None if start is None else F.lit(bytearray(start)), None if end is None else F.lit(bytearray(end))))
        if found and (wanted := list(found.ranges if ranges is None else ranges)) != list(ALL_BUCKETS):
            out = in_ranges(out, wanted)
        return self._placed(out, chosen, late)

    def _placed(self, rows: DataFrame, segments: list[Segment], late: bool) -> DataFrame:
        if not any(s.far for s in segments):
            return rows.drop("far", "segment")
        rows = rows.withColumn("place", F.when(F.col("far"), far_place(F.col("segment"))))
        return rows if late else self.fetched(rows, segments)

    def read_segments(self, segments: list[Segment], ranges: Iterable[Range] | None = None) -> DataFrame:
        out = self._folders(segments)
        return self._placed(out if ranges is None else in_ranges(out, list(ranges)), segments, False)

    def stats(self, version: int | None = None) -> DataFrame:
        """A row a part, that is a segment's family and bucket: counts, expiry, keys and seqs."""
        found = self.manifest(version)
        lasting = F.count(F.when(F.col("exp").isNull() | (F.col("op") == "delete"), 1))
        return self._folders(list(found.segments) if found else []).groupBy(F.col("segment").alias("part"), "bucket", "cf").agg(
            F.count("*").alias("rows"), lasting.alias("lasting"), F.max("exp").alias("last_exp"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
        )

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        """df as files of the store's scratch folder, so that it is what it was, whatever happens to the store; ``vacuum`` deletes them."""
        path = f"{self.path}/scratch/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def vacuum(self, keep: Iterable[int]) -> int:
        """Deletes versions that are not to be kept (the newest always is) and folders that no version names; how many folders."""
        newest = self.versions()[-1:]
        kept = set(keep) | set(newest)
        for v in self.versions():
            if v not in kept:
                self.folder.delete(f"manifest/{v}")
        named = {f"segment={s.name}" for v in self.versions() for s in self.manifest(v).segments}
        dead = [n for n in self.folder.names("data") if n not in named]
        for n in dead:
            self.folder.delete(f"data/{n}")
            self.folder.delete(f"values/{n}")
        self.folder.delete("scratch")
        return len(dead)
