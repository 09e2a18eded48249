"""Folders of data named by pointers: a change takes effect when the next pointer is whole, and not before."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Pointed:
    """A folder with numbered pointers (JSON) that name folders of data.

    No number and no folder is used twice, and the largest pointer that was written to its end counts: whenever a write breaks off, a reader sees what
    was there before. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, pattern: str) -> list:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        self._system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath() for x in self._system.globStatus(folder) or []]

    def _read_pointer(self, folder: str) -> dict:
        return json.loads(self.spark.read.text(folder).first()["value"])

    def _pointer(self) -> dict:
        """The last complete pointer: the marker of success is written when all else is there."""
        done = sorted(p.getParent().toString() for p in self._files("pointer-*/_SUCCESS"))
        return self._read_pointer(done[-1]) if done else {"number": -1}

    def _point(self, pointer: dict) -> None:
        pointer["number"] += 1
        line = self.spark.createDataFrame([(json.dumps(pointer),)], "value string").coalesce(1)
        line.write.text(f"{self.path}/pointer-{pointer['number']:012d}-{uuid.uuid4().hex}")

    def _named(self, pointer: dict) -> set[str]:
        """The folders that a pointer names."""
        raise NotImplementedError

    def vacuum(self) -> None:
        """Deletes pointers but the current one and the one before, and folders that neither names. No reader of an older state may be left."""
        done = sorted((p.getParent() for p in self._files("pointer-*/_SUCCESS")), key=lambda p: p.getName())[-2:]
        named = {p.getName() for p in done}.union(*[self._named(self._read_pointer(p.toString())) for p in done])
        for p in self._files("*-*"):
            if p.getName() not in named:
                self._system.delete(p, True)
