"""Counters and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmerge.operators.ordering import scanned
from colmerge.sources.shared import matched


def counters(events: DataFrame, kinds: list[str], column: str = "event_type") -> DataFrame:
    """One row: how many events there are of each kind."""
    return events.agg(*[F.count_if(F.col(column) == k).alias(k) for k in kinds])


def _with_ranks(rows: DataFrame, value: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, __all, __mean, __most) of all rows; and distinct values ``__x`` that aren't null with ``__to``, how many of the key's values are no larger, and ``__all``.

    Equal values are counted first, in the tasks before the shuffle; the counts are summed up in ranges of key and value. So no task holds
    or sorts the values of a key, however many it has.
    """
    valued = rows.select(*keys, value.alias("__x"))
    totals = valued.groupBy(*keys).agg(F.count("__x").alias("__all"), F.avg("__x").alias("__mean"), F.max("__x").alias("__most"))
    counts = valued.filter("__x is not null").groupBy(*keys, "__x").agg(F.count("*").alias("__n"))
    placed = scanned(counts, keys, ["__x"], {"__to": ("sum", F.col("__n"))})
    return totals, matched(placed, totals.select(*keys, "__all"), keys)


def _at(rank: Column) -> Column:
    """The value at a rank, from 0."""
    return F.min(F.when(F.col("__to") > rank, F.col("__x")))


def percentiles(rows: DataFrame, value: Column, at: dict[str, float], keys: list[str]) -> DataFrame:
    """Percentiles with linear interpolation, mean and largest, by keys; nulls don't count."""
    totals, placed = _with_ranks(rows, value, keys)
    place = {name: p * (F.col("__all") - 1) for name, p in at.items()}
    ends = [_at(end(place[name])).alias(f"__{side}_{name}") for name in at for side, end in (("low", F.floor), ("high", F.ceil))]
    found = matched(totals, placed.groupBy(*keys).agg(*ends), keys)
    shown = []
    for name in at:
        low, high, part = F.col(f"__low_{name}"), F.col(f"__high_{name}"), place[name] - F.floor(place[name])
        shown.append((low * (1 - part) + high * part).alias(name))
    return found.select(*keys, *shown, F.col("__mean").alias("mean"), F.col("__most").alias("most"))


def rank_percentiles(rows: DataFrame, value: str, at: dict[str, int], keys: list[str]) -> DataFrame:
    """The element at position ``n * p / 100`` (whole division) of the sorted values, by keys; nulls don't count."""
    totals, placed = _with_ranks(rows, F.col(value), keys)
    found = placed.groupBy(*keys).agg(*[_at(F.floor(F.col("__all") * p / 100)).alias(name) for name, p in at.items()])
    return matched(totals.select(*keys), found, keys)


def sync_outcome(events: DataFrame, grace: int | None = None, timeout: int | None = None) -> DataFrame:
    """(run_id, outcome, synced): ``Synced`` if any peer synced, ``NoPeers`` if none was seen, else ``TimedOut``; events (run_id, event_type[, at]).

    With ``timeout``, events later than that after a run's first one don't count; with ``grace``, a run ends that long after its first sync. Both
    need ``at``, a number.
    """
    synced, seen = F.col("event_type") == "peer_synced", F.col("event_type") == "peer_connected"
    if timeout is not None:
        begun = events.groupBy("run_id").agg(F.min("at").alias("__begun"))
        events = events.join(begun, "run_id").filter(F.col("at") <= F.col("__begun") + timeout)
    if grace is not None:
        ends = events.filter(synced).groupBy("run_id").agg((F.min("at") + grace).alias("__end"))
        events = events.join(ends, "run_id", "left").filter(F.col("__end").isNull() | (F.col("at") <= F.col("__end")))
    runs = events.groupBy("run_id").agg(F.count_if(synced).alias("synced"), F.count_if(seen).alias("seen"))
    return runs.select("run_id", F.when(F.col("synced") > 0, "Synced").when(F.col("seen") == 0, "NoPeers").otherwise("TimedOut").alias("outcome"), "synced")
