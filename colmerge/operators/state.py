"""Applying changesets to state. State is the change log of winners itself: one row per cell, and one tombstone at most per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmerge.operators.resolve import CELL, liveness, rank, winners
from colmerge.sources.tables import CHANGELOG, TOMBSTONE

COLUMNS = [f.name for f in CHANGELOG]


def applied_cells(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Each cell after a delta, with ``outcome``: insert, update or same. Unseen cells always win; an equal triple changes nothing."""
    old = winners(state).select(*CELL, F.struct("col_version", "val", "site_id").alias("old"))
    new = winners(delta).select(*CELL, F.struct("col_version", "val", "site_id").alias("new"))
    both = old.join(new, CELL, "full_outer")
    won = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") > F.col("old")))
    outcome = F.when(~won, "same").when(F.col("old").isNull(), "insert").otherwise("update")
    return both.withColumn("outcome", outcome).withColumn("w", F.when(won, F.col("new")).otherwise(F.col("old"))).select(*CELL, "w.val", "w.site_id", "w.col_version", "outcome")


def merged(changes: DataFrame) -> DataFrame:
    """The state of a log: winning cells, and each row's longest tombstone."""
    order = F.struct("col_version", "val", "site_id", "cl", "seq", "db_version")
    best = changes.groupBy(*CELL).agg(F.max(order).alias("w"))
    return best.select(*CELL, "w.val", "w.site_id", "w.col_version", "w.cl", "w.seq", "w.db_version").select(*COLUMNS)


def merge(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The new state of both. The same delta again changes nothing."""
    return merged(state.select(*COLUMNS).unionByName(delta.select(*COLUMNS)))


def applied(state: DataFrame, delta: DataFrame, policy: Column | str) -> DataFrame:
    """The state after a delta with deletes: rows whose delete wins keep their tombstone alone, rows that live their cells alone."""
    return compact(merge(state, delta), policy)


def compact(state: DataFrame, policy: Column | str) -> DataFrame:
    """State without the cells of dead rows and the tombstones of living ones."""
    alive = liveness(state, policy).select("tbl", "pk", "alive")
    joined = state.join(alive, ["tbl", "pk"])
    return joined.filter(F.col("alive") == (F.col("cid") != TOMBSTONE)).select(*state.columns)


def as_of(changes: DataFrame, version: int) -> DataFrame:
    """Winners as a database knew them at a version."""
    return winners(changes.filter(F.col("db_version") <= version))


__all__ = ["applied", "applied_cells", "as_of", "compact", "merge", "merged", "rank"]
