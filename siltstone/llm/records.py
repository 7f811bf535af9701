"""Length-delimited binary records of token ids, with a separate offset index.

A record is: length (u64), masked crc32 of those 8 bytes (u32), payload, masked crc32 of the
payload (u32). A payload is: doc_id (i64), flags (u8: bit 0 null doc_id, bits 4-7 bytes an id),
ids. Beside ``X.rec`` lies ``X.idx``: magic, number of records (u64), the offset of each record
(u64), masked crc32 of the offsets; a shuffled reader seeks by it. All numbers are little-endian.

Documents are range-partitioned by doc_id, one file a partition, in ascending order over all
files. An attempt writes files of its own name; the manifest (a table that Spark commits) lists
those of the attempts that counted, so that lost or repeated tasks leave no trace in what is read.

Defined cases: a null text is the empty text and holds the end id alone; an empty table writes no
record; rows of one doc_id are all written, adjacent; a null doc_id comes first; long texts are
one record; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_text, new_folder, prepare, shuffle_partitions
from .word_tokens import word_tokens

MAGIC, MASK_DELTA, NULL_ID = b"SILTREC1", 0xA282EAD8, 1
MANIFEST = "part int, path string, n_records long, n_tokens long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class CorruptRecord(ValueError):
    """A length, checksum or index does not match."""


def masked(data: bytes) -> int:
    """crc32, rotated and shifted, so that a checksum of data holding checksums stays sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RecordWriter:
    def __init__(self, path: str) -> None:
        self.store, self.path = open_store(path)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.path + ".rec")
        self.offsets: list[int] = []
        self.at = 0

    def write(self, payload: bytes) -> None:
        record = frame(payload)
        self.offsets.append(self.at)
        self.at += len(record)
        self.out.write(record)

    def close(self) -> None:
        self.out.close()
        offsets = np.asarray(self.offsets, "<u8").tobytes()
        with self.store.open_output_stream(self.path + ".idx") as out:
            out.write(MAGIC + struct.pack("<Q", len(self.offsets)) + offsets + struct.pack("<I", masked(offsets)))


def _payload(source) -> bytes | None:
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise CorruptRecord("length")
    n = struct.unpack("<Q", head[:8])[0]
    body = source.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise CorruptRecord("payload")
    return body[:n]


def read_records(path: str) -> Iterator[bytes]:
    """All payloads of X.rec in order, checked."""
    store, name = open_store(path)
    with store.open_input_stream(name + ".rec", buffer_size=1 << 20) as source:
        while (payload := _payload(source)) is not None:
            yield payload


def read_index(path: str) -> np.ndarray:
    store, name = open_store(path)
    with store.open_input_file(name + ".idx") as source:
        data = source.read()
    n = struct.unpack("<Q", data[8:16])[0]
    if data[:8] != MAGIC or len(data) != 20 + 8 * n or struct.unpack("<I", data[-4:])[0] != masked(data[16:-4]):
        raise CorruptRecord("index")
    return np.frombuffer(data, "<u8", n, 16)


def read_at(path: str, order: list[int]) -> Iterator[bytes]:
    """The payloads with these numbers, in this order, by the index alone."""
    offsets = read_index(path)
    store, name = open_store(path)
    with store.open_input_file(name + ".rec") as source:
        for i in order:
            source.seek(int(offsets[i]))
            payload = _payload(source)
            if payload is None:
                raise CorruptRecord("offset")
            yield payload


def pack_ids(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qB", doc_id or 0, (NULL_ID if doc_id is None else 0) | width << 4) + ids


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", payload)
    return None if flags & NULL_ID else doc_id, np.frombuffer(payload, f"<u{flags >> 4}", offset=9)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the record files and returns their manifest, in order of ``part``."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_folder(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), word_tokens(tokenizer, end_id)
        writer, n = None, 0
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = RecordWriter(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}")
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist())):
                writer.write(pack_ids(doc_id, ids, tokens.width))
                n += len(ids) // tokens.width
        if writer is not None:
            writer.close()
            name = f"{folder}/{writer.path.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_records": [len(writer.offsets)], "n_tokens": [n], "n_bytes": [writer.at]})

    ordered = id_text(docs).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    return cut(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    spark = manifest.sparkSession
    files, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row a file
        files.append((r["path"], at))
        at += r["n_tokens"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for payload in read_records(path):
                    doc_id, ids = unpack_ids(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield as_batch(rows)
                        rows = []
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

    listing = spark.createDataFrame(files, "path string, start long")
    if files:
        listing = listing.repartition(len(files))
    return listing.mapInArrow(scan, DOCUMENTS)


def token_records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    return read_documents(write_tokens(docs, tokenizer, end_id))


def shuffled(spark: SparkSession, manifest: DataFrame, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents in an order drawn from seed: files shuffled, then the records of each by its index."""
    draw = np.random.default_rng(seed)
    files = manifest.orderBy(F.col("part")).collect()
    for f in draw.permutation(len(files)):
        for payload in read_at(files[f]["path"], draw.permutation(files[f]["n_records"]).tolist()):
            yield unpack_ids(payload)
