"""Replay: changes applied in the order in which they arrived, with the order's effects on deletes and late rows.

Rows are dealt out by key and sorted by arrival, and each task streams them: what it holds is one row's cells and clocks. The rules differ from
converged mode where order matters: a delete takes precedence over other cells of its group; it drops the row's clocks, so that any
later cell wins again; a row that lacks required cells isn't made, and the cells that came stay unclocked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmerge.sources.tables import ADD_WINS, TOMBSTONE, Registry, TableMeta


class _Row:
    """One row of a table while its groups arrive."""

    def __init__(self, meta: TableMeta):
        self.meta = meta
        self.cells: dict[str, str | None] | None = None
        self.clocks: dict[str, tuple[int, str]] = {}
        self.tombstone: int | None = None

    def apply(self, group: list[dict]) -> None:
        delete = next((c for c in group if c["cid"] == TOMBSTONE), None)
        if delete is not None:
            most = max([v for v, _ in self.clocks.values()] + [self.tombstone or 0])
            if delete["cl"] > most or delete["cl"] == most and self.meta.policy != ADD_WINS:
                self.cells, self.clocks, self.tombstone = None, {}, delete["cl"]
            return
        won = {}
        for c in group:
            if c["cid"] not in self.meta.columns or c["cid"] == self.meta.pk:
                continue
            known = self.clocks.get(c["cid"])
            mine = (known[0], (self.cells or {}).get(c["cid"]) or "", known[1]) if known else None
            if mine is None or (c["col_version"], c["val"] or "", c["site_id"]) > mine:
                won[c["cid"]] = c
        if not won:
            return
        if self.cells is None:
            if any(r not in won and r not in self.meta.defaults for r in self.meta.required):
                return
            self.cells = dict(self.meta.defaults)
        for cid, c in won.items():
            self.cells[cid] = c["val"]
            self.clocks[cid] = (c["col_version"], c["site_id"])


def replay(changes: DataFrame, registry: Registry) -> DataFrame:
    """(tbl, pk, cid, val, col_version, site_id): cells of living rows after all of ``changes`` (with ``arrival``: the batch's number)."""
    metas = registry.tables

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, arrival, row, group = None, None, None, []

        def done() -> pa.RecordBatch:
            out = []
            if row is not None and row.cells is not None:
                out = [(*key, cid, val, *row.clocks.get(cid, (0, ""))) for cid, val in sorted(row.cells.items())]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tbl", "pk", "cid", "val", "col_version", "site_id"])

        for batch in batches:
            for c in batch.to_pylist():
                at = (c["tbl"], c["pk"])
                if group and (at != key or c["arrival"] != arrival):
                    row.apply(group)
                    group = []
                if at != key:
                    if key is not None:
                        yield done()
                    key, row = at, _Row(metas[c["tbl"]])
                arrival = c["arrival"]
                group.append(c)
        if group:
            row.apply(group)
        if key is not None:
            yield done()

    known = changes.filter(F.col("tbl").isin(list(metas))).select("tbl", "pk", "arrival", "seq", "cid", "val", "site_id", "col_version", "cl")
    # the last keys fix what a batch with several deletes of a row, or several values of a cell, means: the least delete, the largest value
    ordered = known.repartition("tbl", "pk").sortWithinPartitions("tbl", "pk", "arrival", "seq", "cid", "col_version", "val", "site_id")
    return ordered.mapInArrow(fold, "tbl string, pk string, cid string, val string, col_version long, site_id string")
