"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process, as in tests, one is made; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Paths of the tables that were written, in order.
_TABLES: list[str] = []


def tables_written() -> int:
    return len(_TABLES)


def drop_tables(spark: SparkSession, start: int, end: int) -> None:
    """Deletes the tables written from the ``start``-th on and before the ``end``-th; nothing may read them any more."""
    for path in _TABLES[start:end]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read from there: computed once, whatever becomes of executors.

    Values that depend on how rows are dealt out, like monotonically increasing ids, are fixed with it. The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it: for helper columns beside columns that pass through."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def content_keys(id_column: str, text: str) -> list[Column]:
    """``key_a`` and ``key_b``, 128 bits of the id and the text: the same wherever and whenever a row is read."""
    absent = F.col(id_column).isNull(), F.col(text).isNull()
    return [F.xxhash64(F.lit(1), *absent, id_column, text).alias("key_a"), F.xxhash64(F.lit(2), *absent, text, id_column).alias("key_b")]
