"""Conflict resolution: winners per cell, liveness per row, materialised rows.

Everything here is an aggregation on ``(tbl, pk)`` or ``(tbl, pk, cid)`` with map-side combining, so a hot row or cell is combined before
the shuffle. Null values compare as smallest; the result doesn't depend on the order or the number of deliveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmerge.sources.tables import ADD_WINS, TOMBSTONE, Registry

CELL = ["tbl", "pk", "cid"]
ROW = ["tbl", "pk"]


def rank(version: Column, val: Column, site: Column) -> Column:
    """What orders the candidates of a cell: version, then bytes of the value, then site."""
    return F.struct(version.alias("col_version"), val.alias("val"), site.alias("site_id"))


def winners(changes: DataFrame) -> DataFrame:
    """The winning change of each cell, deletes apart."""
    cells = changes.filter(F.col("cid") != TOMBSTONE)
    best = cells.groupBy(*CELL).agg(F.max(F.struct("col_version", "val", "site_id", "db_version", "cl", "seq")).alias("w"))
    return best.select(*CELL, "w.val", "w.site_id", "w.col_version", "w.cl", "w.seq", "w.db_version")


def cell_winners(changes: DataFrame) -> DataFrame:
    """Winners of all cells, deletes included as ordinary cells and absent values as empty: the rule of sites without delete handling."""
    order = F.struct("col_version", F.coalesce("val", F.lit("")).alias("bytes"), "site_id", "val", "cl", "db_version")
    best = changes.groupBy(*CELL).agg(F.max(order).alias("w"))
    return best.select(*CELL, "w.val", "w.site_id", "w.col_version", "w.cl", "w.db_version")


def should_delete(cl: Column, most: Column, policy: Column | str) -> Column:
    """Whether a delete of causal length ``cl`` removes a row whose latest cell has version ``most``."""
    ties = (F.lit(policy) if isinstance(policy, str) else policy) != ADD_WINS
    return cl.isNotNull() & ((cl > F.coalesce(most, F.lit(0))) | ((cl == F.coalesce(most, F.lit(0))) & ties))


def liveness(changes: DataFrame, policy: Column | str) -> DataFrame:
    """(tbl, pk, mcv, dcl, alive): latest cell version, latest delete, and whether the row lives."""
    dead = F.col("cid") == TOMBSTONE
    rows = changes.groupBy(*ROW).agg(F.max(F.when(~dead, F.col("col_version"))).alias("mcv"), F.max(F.when(dead, F.col("cl"))).alias("dcl"))
    return rows.withColumn("alive", F.col("mcv").isNotNull() & ~should_delete(F.col("dcl"), F.col("mcv"), policy))


def converged(changes: DataFrame, policy: Column | str) -> DataFrame:
    """The winning cells of rows that live, in one pass: cells are aggregated below their rows, so both share the key's exchange."""
    best = changes.groupBy(*CELL).agg(F.max(F.struct("col_version", "val", "site_id", "db_version", "cl", "seq")).alias("w"))
    rows = best.groupBy(*ROW).agg(
        F.max(F.when(F.col("cid") != TOMBSTONE, F.col("w.col_version"))).alias("mcv"),
        F.max(F.when(F.col("cid") == TOMBSTONE, F.col("w.cl"))).alias("dcl"),
        F.filter(F.collect_list(F.struct("cid", "w")), lambda c: c["cid"] != TOMBSTONE).alias("cells"),  # as many as the table has columns
    )
    rows = rows.filter(F.col("mcv").isNotNull() & ~should_delete(F.col("dcl"), F.col("mcv"), policy))
    return rows.select(*ROW, F.inline("cells")).select(*CELL, "w.val", "w.site_id", "w.col_version", "w.cl", "w.seq", "w.db_version")


def materialize(changes: DataFrame, columns: list[str], policy: Column | str, defaults: dict[str, str] | None = None) -> DataFrame:
    """A row (tbl, pk, one column per cell) for each row that lives; ``defaults`` fill cells that nobody wrote."""
    value = {c: F.max(F.when(F.col("cid") == c, F.struct("col_version", "val", "site_id"))) for c in columns}
    dead = F.col("cid") == TOMBSTONE
    rows = changes.groupBy(*ROW).agg(F.max(F.when(~dead, F.col("col_version"))).alias("__mcv"), F.max(F.when(dead, F.col("cl"))).alias("__dcl"), *[w.alias(f"__{c}") for c, w in value.items()])
    rows = rows.filter(F.col("__mcv").isNotNull() & ~should_delete(F.col("__dcl"), F.col("__mcv"), policy))
    filled = [F.coalesce(F.col(f"__{c}.val"), F.lit((defaults or {}).get(c))).alias(c) for c in columns]
    return rows.select(*ROW, *filled)


def deferred(changes: DataFrame, required: list[str]) -> DataFrame:
    """(tbl, pk, n_required, complete): rows that lack a required cell can't be inserted yet."""
    wanted = F.col("cid").isin(required)
    return changes.filter(F.col("cid") != TOMBSTONE).groupBy(*ROW).agg(F.size(F.collect_set(F.when(wanted, F.col("cid")))).cast("long").alias("n_required")).withColumn("complete", F.col("n_required") == len(required))


def valid(changes: DataFrame, registry: Registry) -> DataFrame:
    """Changes of registered tables to registered columns other than the key, and deletes."""
    columns = registry.columns(changes.sparkSession).filter("not is_pk").select("tbl", "cid")
    named = F.col("tbl").isin(list(registry.tables))
    deletes = changes.filter(named & (F.col("cid") == TOMBSTONE))
    cells = changes.filter(named).join(F.broadcast(columns), ["tbl", "cid"], "left_semi")
    return cells.select(*changes.columns).unionByName(deletes)


def conflicts(changes: DataFrame) -> DataFrame:
    """Cells that two or more sites wrote at one version: a row per cell and version with the sites and the winner.

    One row per conflict, not per pair of sites: the number of rows stays linear in the log.
    """
    cells = changes.filter(F.col("cid") != TOMBSTONE).groupBy(*CELL, "col_version", "site_id").agg(F.max("val").alias("val"))
    met = cells.groupBy(*CELL, "col_version").agg(F.count("*").alias("n_sites"), F.max(F.struct("val", "site_id")).alias("w"), F.min(F.struct("val", "site_id")).alias("l"))
    return met.filter("n_sites > 1").select(*CELL, "col_version", "n_sites", F.col("w.site_id").alias("winner"), F.col("w.val").alias("val"), F.col("l.site_id").alias("last"))
