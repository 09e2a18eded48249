"""Interval joins: which intervals a point lies in, as a join on equal keys.

Time is a tree: level 0 has single points, and a node of each level covers ``BASE`` nodes of the one below. An interval is the union of few nodes (at most ``2 * (BASE - 1)``
a level), a point lies in one node of each level, and both meet where a node is the same: once, and only if the point lies in the interval. So the
join has a key that cuts any group by time, and its output is the answer, without rows that a filter drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 8


def _div(x: Column, n: int) -> Column:
    return F.call_function("div", x, F.lit(n).cast("long"))


def _run(low: Column, high: Column) -> Column:
    """low, ..., high - 1."""
    return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))


def _named(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda node: F.struct(F.lit(level).alias("level"), node.alias("node")))


def _cover(start: Column, end: Column, levels: int) -> Column:
    """The nodes whose union is the points from ``start`` to ``end`` - 1, as (level, node)."""
    out = []
    for level in range(levels):
        low, high, inner_low, inner_high = (e for w in (BASE**level, BASE ** (level + 1)) for e in (_div(start + (w - 1), w), _div(end, w)))
        own = F.when(inner_low < inner_high, F.concat(_run(low, inner_low * BASE), _run(inner_high * BASE, high))).otherwise(_run(low, high))
        out.append(_named(own, level))
    return F.flatten(F.array(*out))


def intervals_at(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each point (keys, at, ...) with each interval (keys, start, end, ...) of equal keys that has ``start <= at < end``; whole numbers, an open ``end`` is null.

    Other columns of both are kept, so their names must differ. Points, keys and starts that are null meet nothing.
    """
    bounds = points.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    low, high = (bounds["low"], bounds["high"]) if bounds["low"] is not None else (0, 0)
    levels = next(k for k in range(1, 65) if BASE**k > high - low + 1)
    # no point lies outside
    first, last = F.greatest(F.col(start).cast("long"), F.lit(low).cast("long")) - low, F.least(F.coalesce(F.col(end).cast("long"), F.lit(high + 1)), F.lit(high + 1).cast("long")) - low
    inside = intervals.filter(F.col(start).isNotNull() & (first < last))
    nodes = inside.withColumn("__node", F.explode(_cover(first, last, levels)))
    place = F.col(at).cast("long") - low
    probes = points.filter(F.col(at).isNotNull()).withColumn("__node", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _div(place, BASE**k).alias("node")) for k in range(levels)])))
    return probes.join(nodes, [*keys, "__node"]).drop("__node")
