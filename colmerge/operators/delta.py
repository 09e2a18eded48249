"""Deltas between databases: changes since a version, values joined to clocks, version vectors, lag, changesets, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmerge.operators.ordering import numbered, placed
from colmerge.operators.resolve import CELL
from colmerge.sources.tables import TOMBSTONE

#: Ranges into which a log's versions are cut where peers with different offsets are joined to it.
RANGES = 1024
#: Changes of one array of a changeset.
PACKED = 1 << 16


def changes_since(changes: DataFrame, version: int) -> DataFrame:
    """Changes above a version, which reaches the scan as a filter; 0 means the full history."""
    return changes.filter(F.col("db_version") > version)


def in_order(changes: DataFrame) -> DataFrame:
    """Changes in the order in which a peer applies them: ``place`` counts from 1, with the cell and the site as last keys."""
    return placed(changes, ["db_version", "seq", "tbl", "pk", "cid", "site_id"], "place").orderBy("place")


def with_values(clock: DataFrame, cells: DataFrame) -> DataFrame:
    """Clock rows with the cell's present value from ``cells`` (tbl, pk, cid, val): one join, not a look-up for each row.

    A cell whose row is gone is left out; deletes stay, without a value.
    """
    live = clock.filter(F.col("cid") != TOMBSTONE).join(cells.select(*CELL, "val"), CELL)
    dead = clock.filter(F.col("cid") == TOMBSTONE).withColumn("val", F.lit(None).cast("string"))
    return live.unionByName(dead)


def version_vector(changes: DataFrame) -> DataFrame:
    """(site_id, db_version, n_changes): how far the log of each site goes."""
    return changes.groupBy("site_id").agg(F.max("db_version").alias("db_version"), F.count("*").alias("n_changes"))


def peer_lag(vector: DataFrame, known: DataFrame) -> DataFrame:
    """(peer_id, site_id, lag): how far each peer of ``known`` (peer_id, site_id, db_version) is behind; a site that it hasn't seen counts in full.

    Peers times sites rows, which the answer itself has.
    """
    peers = known.select("peer_id").distinct()
    seen = known.select("peer_id", "site_id", F.col("db_version").alias("seen"))
    rows = peers.crossJoin(vector.select("site_id", "db_version")).join(seen, ["peer_id", "site_id"], "left")
    return rows.select("peer_id", "site_id", (F.col("db_version") - F.coalesce("seen", F.lit(0))).alias("lag"))


def catch_up(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Changes that each peer of ``known`` (peer_id, db_version: what it has seen of this log; 0 or null for nothing) still lacks.

    The smallest offset reaches the scan as a filter. Versions are cut into ``RANGES`` ranges, and a peer asks for those from its offset on, so
    that the join has a key; a row of the join that isn't in the result lies in the range of the offset itself.
    """
    offsets = known.select("peer_id", F.coalesce("db_version", F.lit(0)).alias("seen"))
    least = offsets.agg(F.min("seen")).first()[0] or 0
    lacking = changes.filter(F.col("db_version") > least)
    most = lacking.agg(F.max("db_version")).first()[0] or 0
    width = most // RANGES + 1
    asked = offsets.filter(F.col("seen") < most).withColumn("range", F.explode(F.sequence(F.floor(F.col("seen") / width), F.lit(most // width))))
    met = lacking.withColumn("range", F.floor(F.col("db_version") / width)).join(asked, "range")
    return met.filter(F.col("db_version") > F.col("seen")).drop("seen", "range")


def reset(known: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """Offsets of which those of ``peers`` (peer_id; all by default) are null: the next exchange with them starts from the beginning."""
    none = F.lit(None).cast("long")
    if peers is None:
        return known.withColumn("db_version", none)
    marked = known.join(peers.select("peer_id").distinct().withColumn("__reset", F.lit(True)), "peer_id", "left")
    return marked.withColumn("db_version", F.when(F.col("__reset"), none).otherwise(F.col("db_version"))).drop("__reset")


def advanced(known: DataFrame, delivered: DataFrame) -> DataFrame:
    """Offsets after deliveries (peer_id, db_version): they never go back, and an offset set to null starts from the beginning."""
    both = known.select("peer_id", "db_version").unionByName(delivered.select("peer_id", "db_version"))
    return both.groupBy("peer_id").agg(F.max("db_version").alias("db_version"))


def global_version(*logs: DataFrame, stored: int = 0) -> DataFrame:
    """One row: the largest version of all logs and of the stored counter."""
    found = logs[0].agg(F.max("db_version").alias("v"))
    for log in logs[1:]:
        found = found.unionByName(log.agg(F.max("db_version").alias("v")))
    return found.agg(F.greatest(F.coalesce(F.max("v"), F.lit(0)), F.lit(stored)).cast("long").alias("db_version"))


def next_version(*logs: DataFrame, stored: int = 0) -> DataFrame:
    """One row: the version that the next local write gets, one more than any in use."""
    return global_version(*logs, stored=stored).select((F.col("db_version") + 1).alias("db_version"))


def received(state: DataFrame, delta: DataFrame, stored: int = 0) -> DataFrame:
    """A delta as the receiver keeps it: all its changes under the receiver's own next version, whatever numbers the sender counts by."""
    # one row on the right side
    return delta.drop("db_version").crossJoin(F.broadcast(next_version(state, stored=stored))).select(*delta.columns)


def pack(changes: DataFrame, width: int = 1, most: int = PACKED) -> DataFrame:
    """Changesets: (site_id, changeset, part, changes), an array in order for each range of ``width`` versions of a site, cut into parts of ``most`` changes.

    Only a log that has a longer set (a bulk insert, a received delta) is numbered for that.
    """
    item = F.struct("db_version", "seq", "tbl", "pk", "cid", "val", "col_version", "cl")
    sets = changes.withColumn("changeset", F.floor(F.col("db_version") / width).cast("long"))
    part = F.lit(0).cast("long")
    if not sets.groupBy("site_id", "changeset").count().filter(F.col("count") > most).isEmpty():
        sets = numbered(sets, ["site_id", "changeset"], ["db_version", "seq", "tbl", "pk", "cid", "val", "col_version", "cl"], "__n")
        part = F.call_function("div", F.col("__n") - 1, F.lit(most).cast("long"))
    return sets.groupBy("site_id", "changeset", part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("changes"))


def unpack(changesets: DataFrame) -> DataFrame:
    """The changes of changesets, a row each."""
    return changesets.select("site_id", F.inline("changes"))


def fan_out(changesets: DataFrame, peers: DataFrame) -> DataFrame:
    """A copy of each changeset (site_id, changeset) for each peer (peer_id, site_id, infrastructure, rejected) that may have it.

    A peer doesn't get its own site's changes. The copies are the result; peers are those connected, and aren't broadcast by force.
    """
    eligible = peers.filter("not infrastructure and not rejected").select("peer_id", F.col("site_id").alias("own"))
    return changesets.crossJoin(eligible).filter(F.col("site_id") != F.col("own")).drop("own")
