"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source of weight ``w`` among ``n`` of ``N`` rows has the mean repetition rate ``rate = w * N * epochs / n``. Each document's number of copies
inverts the Poisson distribution of that mean at a uniform number hashed from its id and the seed, so it needs no other row and
no state: the same document gets the same count wherever and whenever it is drawn. A mean above ``MOST_MEAN``, whose first terms
doubles can't tell from 0, is cut into equal parts below it: a sum of Poisson numbers is one of the summed mean, and each part is
drawn from a hash of its own. Copies are exploded and put in an order hashed from id, copy and seed: a global shuffle. As the keys of the order are
uniform, equal ranges of them are the partitions, and nothing has to be sampled to find their bounds.

Cases: a null source is a source of its own; a source without rows does nothing; with given weights, a source that they don't name
has weight 0 (weights and epochs below 0 or not finite are an error); a null id draws like an id of its own; repeated rows of one id draw the same count; an empty table gives an empty
result; other columns pass through, whatever their names, but input columns named ``copy``, ``copies`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmerge.llm.common import shuffle_partitions, unused, written

#: Sources whose rates may be broadcast (8 KB each at most); beyond, the join is salted over so many parts.
BROADCAST_SOURCES, SALTS = 2_000, 64
#: The largest mean that is drawn at once.
MOST_MEAN = 700.0


def uniform(*parts: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over the parts and the seed."""
    key = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, ... as far as doubles tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["sums"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float, source: str) -> DataFrame:
    """(source, n, rate): target weights as given, or proportional to ``n ** alpha``."""
    counts = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("weight", weight.cast("double"))
    total = counts.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows"))
    # one row on the right side
    return counts.crossJoin(F.broadcast(total)).select("source", "n", F.coalesce(F.try_divide(F.col("weight") * F.col("rows") * F.lit(float(epochs)), F.col("weights") * F.col("n")), F.lit(0.0)).alias("rate"))


def _drawn(key: Column, parts: Column, cdf: Column, first: Column, seed: int) -> Column:
    """The sum of a row's Poisson numbers, one for each part of its mean; the first is drawn at ``first``."""

    def inverted(u: Column) -> Column:
        return F.size(F.filter(cdf, lambda c: u >= c)).cast("long")

    def add(total: Column, part: Column) -> Column:
        return total + inverted(uniform(key, part, seed=seed))

    more = F.aggregate(F.sequence(F.lit(1).cast("long"), parts - 1), inverted(first), add)
    return F.when(parts > 1, more).otherwise(inverted(first))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 7, id_column: str = "doc_id", source: str = "source", shuffle: bool = True) -> DataFrame:
    """``docs`` repeated to the target mix, with ``copy`` (from 0), ``copies`` and ``shuffle_key``, in the order of ``shuffle_key``."""
    check_weights([*(weights or {}).values(), epochs])
    docs = docs.select(*[c for c in docs.columns if c not in ("copy", "copies", "shuffle_key")])
    names = unused(docs.columns, "source_of_rate", "parts", "cdf", "drawn_at", "salt", "row_salt", "range")
    of, parts, cdf, at, salt, row_salt, place = names
    rates = source_rates(docs, weights, alpha, epochs, source).filter(F.col("rate") > 0)
    cut = F.ceil(F.col("rate") / MOST_MEAN)
    rates = written(rates.select(F.col("source").alias(of), cut.alias(parts), poisson_cdf(F.col("rate") / cut).alias(cdf)))
    key = F.col(source).cast("string")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), key.eqNullSafe(F.col(of)))
    else:
        spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(row_salt, F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, (F.col(row_salt) == F.col(salt)) & key.eqNullSafe(F.col(of)))
    drawn = joined.withColumn(at, uniform(F.col(id_column), seed=seed)).withColumn("copies", _drawn(F.col(id_column), F.col(parts), F.col(cdf), F.col(at), seed))
    drawn = drawn.filter("copies > 0").drop(*names)
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("")), "copy", F.lit(f"{seed}:order"))))
    if not shuffle:
        return keyed
    n = shuffle_partitions(docs.sparkSession)
    share = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ranged = keyed.withColumn(place, F.floor(share * n).cast("int")).repartitionById(n, F.col(place))
    return ranged.sortWithinPartitions("shuffle_key", "copy").drop(place)


def check_weights(values: list[float]) -> None:
    """Weights and epochs must be finite and not below 0."""
    if any(not math.isfinite(x) or x < 0 for x in values):
        raise ValueError(f"weights and epochs must be finite and not below 0, not {values}")
