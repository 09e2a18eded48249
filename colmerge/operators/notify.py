"""Change notifications and views that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmerge.operators.resolve import CELL, ROW, rank, should_delete
from colmerge.sources.tables import TOMBSTONE


def notifications(state: DataFrame, delta: DataFrame, policy: Column | str) -> DataFrame:
    """(tbl, pk, kind, changed_columns, column_values): one event for each row that a delta changes.

    Only rows of the delta are looked at, in one aggregation by cell and one by row. A delete that is delivered again makes no event.
    """
    columns = [*CELL, "val", "site_id", "col_version", "cl"]
    touched = delta.select(*ROW).distinct()
    old = state.join(touched, ROW, "left_semi").select(*columns, F.lit(True).alias("known"))
    both = old.unionByName(delta.select(*columns, F.lit(False).alias("known")))
    known, dead = F.col("known"), F.col("cid") == TOMBSTONE
    order = rank(F.col("col_version"), F.col("val"), F.col("site_id"))
    cells = both.groupBy(*CELL).agg(F.max(F.when(known, order)).alias("old"), F.max(F.when(~known, order)).alias("new"), F.max(F.when(known, F.col("cl"))).alias("old_cl"), F.max("cl").alias("all_cl"))
    won = ~dead & F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") > F.col("old")))
    versions = {"old_most": F.when(~dead, F.col("old.col_version")), "old_dead": F.when(dead, F.col("old_cl")), "most": F.when(~dead, F.greatest("old.col_version", "new.col_version")), "dead": F.when(dead, F.col("all_cl"))}
    # as many changed cells as the table has columns
    changed = F.array_sort(F.collect_list(F.when(won, F.struct("cid", F.col("new.val").alias("val"))))).alias("changed")
    rows = cells.groupBy(*ROW).agg(*[F.max(v).alias(name) for name, v in versions.items()], changed)
    was, alive = (F.col(most).isNotNull() & ~should_delete(F.col(dead_), F.col(most), policy) for most, dead_ in (("old_most", "old_dead"), ("most", "dead")))
    rows = rows.select(*ROW, was.alias("was"), alive.alias("alive"), F.when(F.size("changed") > 0, F.col("changed")).alias("column_values"))
    kind = F.when(F.col("was") & ~F.col("alive"), "Delete").when(~F.col("was") & F.col("alive"), "Insert").when(F.col("was") & F.col("alive") & F.col("column_values").isNotNull(), "Update")
    shown = F.when(kind != "Delete", F.col("column_values"))
    names = F.array_join(F.transform(shown, lambda c: c["cid"]), ",")
    return rows.select(*ROW, kind.alias("kind"), names.alias("changed_columns"), shown.alias("column_values")).filter("kind is not null")


def fold_view(events: DataFrame, position: str = "position") -> DataFrame:
    """Cells (tbl, pk, cid, val) of a view after events in the order of ``position``: writes patch cells, a delete drops the row so far."""
    last = events.groupBy(*CELL).agg(F.max(F.struct(F.col(position).alias("at"), "val")).alias("w"))
    rows = last.groupBy(*ROW).agg(
        F.max(F.when(F.col("cid") == TOMBSTONE, F.col("w.at"))).alias("gone"),
        F.filter(F.collect_list(F.struct("cid", "w")), lambda c: c["cid"] != TOMBSTONE).alias("cells"),  # as many as the table has columns
    )
    cells = rows.select(*ROW, "gone", F.inline("cells"))
    return cells.filter(F.col("gone").isNull() | (F.col("w.at") > F.col("gone"))).select(*CELL, "w.val")


def only(events: DataFrame, tbl: str, pk: str | None = None) -> DataFrame:
    """Events of one table, or of one of its rows."""
    out = events.filter(F.col("tbl") == tbl)
    return out if pk is None else out.filter(F.col("pk") == pk)
