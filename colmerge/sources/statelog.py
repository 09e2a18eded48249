"""State as a log of deltas: what a batch writes grows with the batch, not with the state."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colmerge.sources.pointers import Pointed
from colmerge.sources.tables import CHANGELOG


class StateLog(Pointed):
    """State in runs: each commit adds one, of the cells that it brings; reads merge the runs; folding merges runs of one level into one of a higher level.

    A run's level is the logarithm, by ``ratio``, of its number of rows over ``least``. Once a level has ``ratio`` runs, ``fold`` merges them. So each row is
    rewritten once a level, and a read merges at most ``ratio`` runs a level. A run lies in buckets by a hash of its rows' keys, a power of two of
    them that follows its size up to ``most_buckets`` (each is a folder, and those of a large run hold more rows); a read for some keys opens only their buckets.

    A pointer names the runs, and the last batch of each stream that has been committed: state and ledger change in one step.
    """

    def __init__(self, spark: SparkSession, path: str, ratio: int = 4, least: int = 1 << 16, bucket_rows: int = 1 << 20, most_buckets: int = 32):
        if ratio < 2:
            raise ValueError("the ratio of levels must be 2 at least")
        if most_buckets < 1 or most_buckets & (most_buckets - 1):
            raise ValueError("the most buckets of a run must be a power of two")
        super().__init__(spark, path)
        self.ratio, self.least, self.bucket_rows, self.most_buckets = ratio, least, bucket_rows, most_buckets

    def _named(self, pointer: dict) -> set[str]:
        return {run["folder"] for run in pointer["runs"]}

    def _pointer(self) -> dict:
        return {"runs": [], "ledger": {}} | super()._pointer()

    def _level(self, rows: int) -> int:
        return max(0, math.floor(math.log(max(rows, 1) / self.least, self.ratio)) + 1) if rows > self.least else 0

    def _run(self, cells: DataFrame, rows: int) -> dict | None:
        """Writes a run of about ``rows`` cells."""
        buckets = min(self.most_buckets, 1 << max(0, math.ceil(math.log2(max(1, rows) / self.bucket_rows))))
        folder = f"run-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("tbl", "pk"), F.lit(buckets)).cast("int")
        dealt = cells.select(*CHANGELOG.names, bucket.alias("__bucket")).hint("rebalance", "__bucket").sortWithinPartitions("__bucket", "tbl", "pk", "cid")
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        there = self._opened({"folder": folder}).count()
        return {"folder": folder, "rows": there, "buckets": buckets, "level": self._level(there)} if there else None

    def _opened(self, run: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType([*CHANGELOG.fields, T.StructField("__bucket", T.IntegerType())])).parquet(f"{self.path}/{run['folder']}")

    def runs(self) -> list[dict]:
        """(folder, rows, buckets, level) of the runs, oldest first."""
        return self._pointer()["runs"]

    def ledger(self) -> dict[str, int]:
        """The last batch of each stream that is in the state."""
        return self._pointer()["ledger"]

    def committed(self, stream: str = "") -> int:
        """The last batch of one stream; -1 if none is in the state."""
        return self.ledger().get(stream, -1)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The state, or that of the rows of ``keys`` (tbl, pk)."""
        from colmerge.operators.state import merged

        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], CHANGELOG)
        opened = [self._opened(run) for run in runs]
        if keys is not None:
            # one number a bucket at most; as all are powers of two, that of the largest tells those of the others
            most = max(run["buckets"] for run in runs)
            asked = [r["b"] for r in keys.select(F.pmod(F.xxhash64("tbl", "pk"), F.lit(most)).alias("b")).distinct().collect()]
            opened = [rows.filter(F.col("__bucket").isin(sorted({b % run["buckets"] for b in asked}))) for rows, run in zip(opened, runs, strict=True)]
        rows = opened[0]
        for more in opened[1:]:
            rows = rows.unionByName(more)
        if keys is not None:
            rows = rows.join(keys.select("tbl", "pk").distinct(), ["tbl", "pk"], "left_semi")
        return merged(rows)

    def commit(self, delta: DataFrame, batch: int | None = None, stream: str = "") -> bool:
        """Adds the cells of ``delta``. With a number, a batch of ``stream`` that is committed already, or older, changes nothing: false."""
        from colmerge.operators.state import merged

        pointer = self._pointer()
        if batch is not None and batch <= pointer["ledger"].get(stream, -1):
            return False
        cells = merged(delta).persist()  # counted, then written
        run = self._run(cells, cells.count())
        cells.unpersist()
        if run:
            pointer["runs"].append(run)
        if batch is not None:
            pointer["ledger"][stream] = batch
        self._point(pointer)
        return True

    def fold(self) -> int:
        """Merges the runs of each level that has ``ratio`` of them; returns how many rows were written. The state stays as it is."""
        from colmerge.operators.state import merged

        wrote, pointer = 0, self._pointer()
        while True:
            by_level: dict[int, list[dict]] = {}
            for run in pointer["runs"]:
                by_level.setdefault(run["level"], []).append(run)
            full = sorted(level for level, runs in by_level.items() if len(runs) >= self.ratio)
            if not full:
                return wrote
            old = by_level[full[0]]
            cells = self._opened(old[0])
            for run in old[1:]:
                cells = cells.unionByName(self._opened(run))
            new = self._run(merged(cells), sum(run["rows"] for run in old))
            wrote += new["rows"]
            pointer["runs"] = [new, *(run for run in pointer["runs"] if run not in old)]
            self._point(pointer)
