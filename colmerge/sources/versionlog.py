"""The change log laid out by version, so that a delta reads what is newer and nothing else."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmerge.operators.delta import catch_up
from colmerge.sources.pointers import Pointed
from colmerge.sources.tables import CHANGELOG


def _step(folder: dict) -> int:
    """How many ranges a folder joins: 1 where its pointer doesn't say."""
    return folder.get("step", 1)


class VersionLog(Pointed):
    """A log in ranges of ``width`` versions: each append writes a folder for each range that it has changes of, and a pointer to all folders with their least and
    largest version and their number of rows. Changes lie in order of versions in their files, so that row groups can be skipped too.

    A write that spans more than ``most_folders`` ranges joins ``step`` of them, a power of two, in each folder: so folders are as few for a long history as for a
    short one, and the order inside the files lets row groups be skipped instead.

    A version of very many changes (a bulk insert, a received delta) is several files of one folder. ``compact`` puts the folders of a range together.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 1 << 16, most_folders: int = 64):
        super().__init__(spark, path)
        self.width, self.most_folders = width, most_folders

    def _named(self, pointer: dict) -> set[str]:
        return {f["folder"].split("/")[0] for f in pointer["folders"]}

    def folders(self) -> list[dict]:
        """(folder, range, step, least, most, n) of the folders, oldest first."""
        return self._pointer().get("folders", [])

    def _written(self, changes: DataFrame) -> list[dict]:
        """Writes changes; a change without a version belongs to the range of version 0."""
        folder = f"data-{uuid.uuid4().hex}"
        ranges = F.coalesce(F.floor(F.col("db_version") / self.width), F.lit(0)).cast("long")
        changes = changes.select(*CHANGELOG.names).persist()  # looked at for its versions and for the borders, then written
        low, high = changes.agg(F.min(ranges), F.max(ranges)).first()
        step = 1
        while low is not None and high // step - low // step >= self.most_folders:
            step *= 2
        ranges = ranges - F.pmod(ranges, F.lit(step).cast("long"))
        dealt = changes.select(*CHANGELOG.names, ranges.alias("range")).repartitionByRange("range", "db_version", "tbl", "pk", "cid").sortWithinPartitions("range", "db_version")
        dealt.write.partitionBy("range").parquet(f"{self.path}/{folder}")
        changes.unpersist()
        found = self._opened([folder]).groupBy("range").agg(F.min("db_version").alias("least"), F.max("db_version").alias("most"), F.count("*").alias("n"))
        return [r.asDict() | {"folder": f"{folder}/range={r['range']}", "step": step} for r in found.collect()]  # a row a range

    def _opened(self, folders: list[str]) -> DataFrame:
        schema = T.StructType([*CHANGELOG.fields, T.StructField("range", T.LongType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        # the base path tells Spark that the ranges are partitions, also where folders of several writes are read
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.path}/{base}").parquet(*[f"{self.path}/{f}" for f in folders if f.split("/")[0] == base]) for base in dict.fromkeys(f.split("/")[0] for f in folders)]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows

    def append(self, changes: DataFrame) -> None:
        pointer = self._pointer()
        pointer["folders"] = pointer.get("folders", []) + self._written(changes)
        self._point(pointer)

    def since(self, version: int = 0) -> DataFrame:
        """Changes above a version; 0 means all. Folders without one aren't listed or opened."""
        newer = [f for f in self.folders() if version == 0 or f["most"] is not None and f["most"] > version]
        rows = self._opened([f["folder"] for f in newer])
        if version:
            first, step = version // self.width, max((_step(f) for f in newer), default=1)
            rows = rows.filter((F.col("range") >= first - first % step) & (F.col("db_version") > version))
        return rows.select(*CHANGELOG.names)

    def catch_up(self, known: DataFrame) -> DataFrame:
        """``operators.delta.catch_up`` over what is newer than the least offset of ``known`` (peer_id, db_version)."""
        least = known.agg(F.min(F.coalesce("db_version", F.lit(0)))).first()[0] or 0
        return catch_up(self.since(least), known)

    def compact(self, most: int = 8) -> int:
        """Puts together the folders of each range that lies in more than ``most`` of them; returns how many rows were written."""
        pointer = self._pointer()
        by_place: dict[tuple[int, int], list[dict]] = {}
        for f in pointer.get("folders", []):
            by_place.setdefault((_step(f), f["range"]), []).append(f)
        steps, crowded = sorted({step for step, _ in by_place}), set()
        for _, at in by_place:
            over = [(step, at - at % step) for step in steps if (step, at - at % step) in by_place]
            if sum(len(by_place[place]) for place in over) > most:
                crowded.update(over)
        old = [f for place in crowded for f in by_place[place]]
        if not old:
            return 0
        new = self._written(self._opened([f["folder"] for f in old]).select(*CHANGELOG.names))
        pointer["folders"] = new + [f for f in pointer["folders"] if f not in old]
        self._point(pointer)
        return sum(f["n"] for f in new)
