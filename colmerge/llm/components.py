"""Connected components of links between numbered nodes, by alternating stars.

A round lets every node pass its smallest neighbour to its larger neighbours (large star), then to its smaller ones (small star). The links
turn into stars around each component's smallest node in a number of rounds that grows with the logarithm of the longest path. All rounds are
joins and aggregations with map-side combining; a node with very many links is a skewed key of a join, which Spark splits. Each round's
links are written to the shared folder. Only their number and a checksum reach the driver.

Cases: links from a node to itself, repeated links and null ends are dropped; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmerge.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ends = ends.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written, so that the join deals out both sides: only then can Spark split a node with very many links
    least = written(ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    met = ends.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every linked node with the smallest node that it reaches."""
    ends = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    now = written(ends.filter("x is not null and y is not null and a <> b").select("a", "b").distinct())
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sums == seen or not sums[0]:
            break
        seen = sums
        now = written(_star(_star(now, True), False))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
