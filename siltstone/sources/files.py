"""Small checksummed files beside the data, through Hadoop's file systems, whatever the scheme."""

from __future__ import annotations

import json
import uuid
import zlib
from typing import Any

from pyspark.sql import SparkSession

from ..errors import ChecksumMismatch, Conflict


def sealed(body: Any) -> str:
    """JSON with its checksum."""
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"body": text, "crc32": zlib.crc32(text.encode())})


def unsealed(text: str, what: str = "metadata") -> Any:
    try:
        outer = json.loads(text)
        body, crc = outer["body"], outer["crc32"]
    except (ValueError, KeyError, TypeError) as e:
        raise ChecksumMismatch(what) from e
    if zlib.crc32(body.encode()) != crc:
        raise ChecksumMismatch(what)
    return json.loads(body)


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = "") -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _system(self) -> Any:
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._system().exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        fs = self._system()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._at(name))) if fs.exists(self._at(name)) else []

    def size(self, name: str = "") -> int:
        return self._system().getContentSummary(self._at(name)).getLength() if self.exists(name) else 0

    def modified(self, name: str) -> int:
        """Milliseconds of the epoch."""
        return self._system().getFileStatus(self._at(name)).getModificationTime()

    def read(self, name: str) -> str:
        source = self._system().open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def write(self, name: str, text: str, replace: bool = False) -> None:
        """Written aside and renamed, so that no reader sees half of it; an existing file is a conflict unless replaced."""
        fs, aside = self._system(), f"{name}.{uuid.uuid4().hex}.part"
        if not replace and fs.exists(self._at(name)):
            raise Conflict(f"{name} exists")
        out = fs.create(self._at(aside), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            files.rename(self._at(aside), self._at(name), options)
        except Exception as e:
            fs.delete(self._at(aside), False)
            raise Conflict(f"{name} was written meanwhile") from e

    def delete(self, name: str) -> bool:
        return self._system().delete(self._at(name), True)

    def write_sealed(self, name: str, body: Any, replace: bool = False) -> None:
        self.write(name, sealed(body), replace)

    def read_sealed(self, name: str) -> Any:
        return unsealed(self.read(name), name)
