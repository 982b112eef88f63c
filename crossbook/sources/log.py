"""A log of numbered JSON files, each created once: the commits of snapshots and histories."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: File systems whose files appear whole when they are closed; there a rename isn't atomic, but a create that doesn't replace is.
OBJECT_STORES = ("s3a", "gs", "abfs", "abfss", "oss")


class Log:
    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._conf, self._gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.folder = folder.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _file(self, number: int):
        return self._path(f"{number:020d}.json")

    def numbers(self) -> list[int]:
        """Numbers of the files there are, ascending."""
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict | None:
        """The file's contents, or None where it isn't there (any more)."""
        if not self._fs.exists(self._file(number)):
            return None
        stream = self._fs.open(self._file(number))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The last number and its contents; (-1, None) for an empty log."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, None)

    def _write(self, path, entry: dict) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()

    def create(self, number: int, entry: dict) -> bool:
        """Creates the file, whole or not at all; False where another writer was first."""
        self._fs.mkdirs(self._path(""))
        target = self._file(number)
        try:
            if self._fs.getUri().getScheme() in OBJECT_STORES:
                self._write(target, entry)
                return True
            aside = self._path(f".{uuid.uuid4().hex}")
            self._write(aside, entry)
            try:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
                context.rename(aside, target, self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))  # never replaces
            finally:
                self._fs.delete(aside, False)
        except Py4JJavaError as e:
            if self.read(number) is None:
                raise e
            return False
        return True

    def delete(self, number: int) -> None:
        self._fs.delete(self._file(number), False)

    def remove_folder(self, folder: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)
