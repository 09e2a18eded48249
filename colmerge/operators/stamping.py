"""Local writes become versioned changes: cells, deletes, and the versions of a site's database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmerge.operators.ordering import numbered, placed, scanned
from colmerge.operators.resolve import CELL, ROW
from colmerge.sources.shared import matched
from colmerge.sources.tables import TOMBSTONE, Registry

#: What the names of the library's own tables begin with.
INTERNAL = "_colmerge"


def syncable(writes: DataFrame, registry: Registry) -> DataFrame:
    """Writes (tbl, pk, ...) that go to the log: to registered tables that aren't the library's own, with a key that is there and not empty."""
    named = F.col("tbl").isin(list(registry.tables)) & ~F.startswith("tbl", F.lit(INTERNAL))
    return writes.filter(named & F.col("pk").isNotNull() & (F.col("pk") != ""))


def stamp_writes(writes: DataFrame, clock: DataFrame | None = None, order: str = "event_id", base_version: int = 0) -> DataFrame:
    """``writes`` (tbl, pk, cid, order, ...) with ``col_version`` (one more than the cell had) and ``db_version`` (one per statement).

    Rows of one statement share ``order``; ``clock`` (tbl, pk, cid, col_version) holds versions from before. Nulls are keys and statements like any others.
    """
    statements = placed(writes.select(order).distinct(), [order], "__db")
    out = numbered(matched(writes, statements, [order]), CELL, order, "__n")
    had = F.lit(0)
    if clock is not None:
        out, had = matched(out, clock.select(*CELL, F.col("col_version").alias("__had")), CELL), F.coalesce("__had", F.lit(0))
    return out.withColumn("col_version", (F.col("__n") + had).cast("long")).withColumn("db_version", F.col("__db") + base_version).drop("__n", "__db", "__had")


def stamp_deletes(writes: DataFrame, order: str = "event_id") -> DataFrame:
    """The deletes among ``writes`` with ``cl`` and ``cleared`` (a later write of the row removes the tombstone).

    ``cl`` is one more than the latest version of any of the row's cells; a repeated delete counts on from the standing tombstone. All are running
    values over a row's history, which is scanned in ranges.
    """
    alive = (F.col("cid") != TOMBSTONE).cast("int")
    versions = scanned(writes, CELL, [order], {"__v": ("sum", F.lit(1).cast("long"))}).withColumn("__v", F.when(F.col("cid") != TOMBSTONE, F.col("__v")))
    history = scanned(versions, ROW, [order], {"__most": ("max", F.col("__v")), "__writes": ("sum", alive)}).drop("__v")
    deletes = numbered(history.filter(F.col("cid") == TOMBSTONE), [*ROW, "__writes"], order, "__again")
    rows = writes.groupBy(*ROW).agg(F.sum(alive).alias("__all"))
    deletes = matched(deletes, rows, ROW).withColumn("cleared", F.col("__all") > F.col("__writes"))
    return deletes.withColumn("cl", (F.coalesce("__most", F.lit(0)) + F.col("__again")).cast("long")).drop("__most", "__writes", "__again", "__all", "col_version")
