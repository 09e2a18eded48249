"""The folder that a cluster shares, tables written to it so that they are computed once, settings for a while, and joins in which nulls match."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, which all executors share; a temporary one only where that is unset and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base}/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder, which goes when the session ends: what depends on how rows are dealt out is fixed with it."""
    spark = rows.sparkSession
    path = shared_folder(spark)
    rows.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session inside a ``with``. Who finds the value set already leaves it to whoever set it, so that the one of before comes back."""
    before = spark.conf.get(key, None)
    if before == value:
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def matched(rows: DataFrame, others: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined to ``others`` on ``keys``, of which nulls match nulls."""
    renamed = others.withColumnsRenamed({k: f"__other_{k}" for k in keys})
    on = reduce(and_, [rows[k].eqNullSafe(renamed[f"__other_{k}"]) for k in keys])
    return rows.join(renamed, on, how).drop(*[f"__other_{k}" for k in keys])
