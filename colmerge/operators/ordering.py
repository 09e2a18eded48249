"""Numbers and running values in an order, without one task for a key and without one for the whole.

Rows are laid out in ranges of all columns of the order, whose borders Spark takes from a sample of the rows: a key with most of the rows, a version that all
rows share, or keys with one prefix are split like any others. The ranges are written once to the shared folder. Inside a range, values are
those of a window over the range and the key; what a key carries over from earlier ranges is known from each range's last key, one row a range.

Nulls are ordinary values here, in keys and in orders, and come first; an empty table stays empty. Rows that are equal in all columns of the order get
different numbers, in an order that is fixed once they are written. Columns may have any names but those that begin with ``__scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmerge.sources.shared import matched, written

#: Functions whose values over two parts follow from the value over each.
_COMBINED = {"sum": F.sum, "max": F.max, "min": F.min, "bit_xor": F.bit_xor}


def laid_out(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` in sorted ranges, with ``__scan_part`` (the range) and ``__scan_at`` (the place in it, from 0), written."""
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__scan_id", F.monotonically_increasing_id())
    part, at = F.shiftright("__scan_id", 33).cast("int"), F.col("__scan_id").bitwiseAND((1 << 33) - 1)
    return written(ranges.withColumn("__scan_part", part).withColumn("__scan_at", at).drop("__scan_id"))


def _fixed(few: DataFrame) -> DataFrame:
    """Rows of which there is one a range at most, computed once and handed to all tasks: ranges are as many as a shuffle has partitions."""
    return F.broadcast(few.sparkSession.createDataFrame(few.collect(), few.schema))


def placed(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: 1, 2, ... in the order of some columns."""
    laid = laid_out(rows, order)
    earlier = Window.orderBy("__scan_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("__scan_part").agg(F.count("*").alias("__scan_n"))  # a row a range
    shifts = sizes.select("__scan_part", F.coalesce(F.sum("__scan_n").over(earlier), F.lit(0)).alias("__scan_before"))
    numbers = laid.join(_fixed(shifts), "__scan_part").withColumn(out, F.col("__scan_before") + F.col("__scan_at") + 1)
    return numbers.drop("__scan_part", "__scan_at", "__scan_before")


def scanned(rows: DataFrame, keys: list[str], order: list[str], running: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """``rows`` with running values among rows of equal ``keys``, in the order of ``order``.

    ``running`` has (sum, max, min or bit_xor, what of) by the name of the new column. Values cover the rows up to each row, or with ``before`` those before it; null where none has one.
    """
    values = {f"__scan_v{k}": (kind, value) for k, (kind, value) in enumerate(running.values())}
    rows = rows.withColumns({name: value for name, (_, value) in values.items()})
    laid = laid_out(rows, [*keys, *order]).withColumn("__scan_key", F.struct(F.lit(0), *keys))
    # one row a range: its first key, its last one, and what the rows of its last key sum up to
    asked = laid.filter("__scan_at = 0").select("__scan_part", "__scan_key", F.lit(0).alias("__scan_side"))
    sizes = laid.groupBy("__scan_part").agg(F.max("__scan_at").alias("__scan_most"))
    last = laid.join(F.broadcast(sizes), "__scan_part").filter("__scan_at = __scan_most").select("__scan_part", F.col("__scan_key").alias("__scan_last"))
    same = laid.join(F.broadcast(last), "__scan_part").filter("__scan_key = __scan_last")
    totals = same.groupBy("__scan_part").agg(*[_COMBINED[kind](name).alias(name) for name, (kind, _) in values.items()])
    totals = totals.join(last.withColumnRenamed("__scan_last", "__scan_key"), "__scan_part").withColumn("__scan_side", F.lit(1))
    both = asked.unionByName(totals, allowMissingColumns=True)
    # a range's first key comes before its last, so that its own rows aren't carried over to it
    earlier = Window.partitionBy("__scan_key").orderBy("__scan_part", "__scan_side").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumns({f"{name}c": _COMBINED[kind](name).over(earlier) for name, (kind, _) in values.items()}).filter("__scan_side = 0")
    carried = carried.select("__scan_part", F.col("__scan_key").alias("__scan_first"), *[f"{name}c" for name in values])
    carried = _fixed(carried.filter(" or ".join(f"{name}c is not null" for name in values)))
    inside = Window.partitionBy("__scan_part", "__scan_key").orderBy("__scan_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = laid.withColumns({f"{name}l": _COMBINED[kind](name).over(inside) for name, (kind, _) in values.items()})
    joined = local.join(carried, "__scan_part", "left").withColumn("__scan_same", F.col("__scan_key") == F.col("__scan_first"))
    out = {}
    for name, (made, (kind, _)) in zip(running, values.items(), strict=True):
        own, more = F.col(f"{made}l"), F.when(F.col("__scan_same"), F.col(f"{made}c"))
        out[name] = F.greatest(own, more) if kind == "max" else F.least(own, more) if kind == "min" else F.coalesce(own + more if kind == "sum" else own.bitwiseXOR(more), own, more)
    return joined.withColumns(out).drop(*[c for c in joined.columns if c.startswith("__scan")])


def numbered(rows: DataFrame, keys: list[str], order: str | list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: 1, 2, ... by ``order`` among rows of equal ``keys``."""
    order = [order] if isinstance(order, str) else order
    return scanned(rows, keys, order, {out: ("sum", F.lit(1).cast("long"))}) if keys else placed(rows, order, out)


def counted(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``numbered`` for long groups: a number follows from the place in the range and from where the key's rows begin there, so that neither a window nor another sort goes over the rows.

    What is joined has a row for each range and key in it: it is written, so that Spark knows its size.
    """
    laid = laid_out(rows, [*keys, *order])
    begun = laid.groupBy("__scan_part", *keys).agg(F.min("__scan_at").alias("__scan_first"), F.count("*").alias("__scan_n"))
    earlier = Window.partitionBy(*keys).orderBy("__scan_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(begun.select("__scan_part", *keys, (F.coalesce(F.sum("__scan_n").over(earlier), F.lit(0)) + 1 - F.col("__scan_first")).alias("__scan_shift")))
    return matched(laid, shifts, ["__scan_part", *keys], "inner").withColumn(out, F.col("__scan_at") + F.col("__scan_shift")).drop("__scan_part", "__scan_at", "__scan_shift")
