"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix. DataFrame functions only.

Rows lie in blocks of about ``BLOCK_ROWS`` rows (``BLOCKS`` blocks at least) by a hash of their id. Of each block only its number of rows goes to the
driver, and its row of the matrix comes back by broadcast: some bytes for a million rows. There the numbers of rows that each block sends to each shard are drawn exactly: shard sizes are fixed (counts at most
one apart), and a block's row of the matrix is a multivariate hypergeometric draw from what the shards still lack. Then rows

1. permute inside their block (rank by a hash) and take the shards in the order of the block's matrix row;
2. are exchanged: each shard is dealt on to parts (of about ``BLOCK_ROWS`` rows, ``PARTS`` at least) by a second hash, so no task holds a whole shard;
3. permute again: a row's slot is the number of rows in the shard's earlier parts, plus its rank by that hash in its part.

Only keys, sizes and checksums travel. Cases: a null text has size 1 and the checksum of the empty text; a null id is a key like any
other; repeated rows are rows of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colmerge.llm.common import written

BLOCKS, PARTS, BLOCK_ROWS = 1024, 64, 1_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, drawn without replacement from ``good + bad``, are good: inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    below = above = p
    a = b = mode
    while u >= 0:
        if a == low and b == high:  # what rounding leaves
            return mode
        if b < high:
            above *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= above
            if u < 0:
                return b
        if a > low:
            below *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= below
            if u < 0:
                return a
    return mode


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each block to each shard: row sums are the blocks' sizes, column sums the shards' sizes, at most one apart."""
    rng = random.Random(seed)
    total = sum(blocks)
    lacking = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for size in blocks:
        row, rest, left = [], sum(lacking), size
        for s in range(shards):
            rest -= lacking[s]
            n = hypergeometric(rng, lacking[s], rest, left)
            row.append(n)
            lacking[s] -= n
            left -= n
        matrix.append(row)
    return matrix


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 11, id_column: str = "doc_id", text: str = "text", blocks: int | None = None, parts: int | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row of ``docs`` in one of ``shards`` shards, at a slot that counts from 0."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        # the row's own place breaks up an id that very many rows repeat
        F.xxhash64(F.lit(seed), F.col(id_column), F.monotonically_increasing_id()).alias("first"),
    )
    # written once: both passes over the keys must see the same hashes
    rows = written(rows)
    count = rows.count()
    blocks = blocks or max(BLOCKS, -(-count // BLOCK_ROWS))
    parts = parts or max(PARTS, -(-count // (shards * BLOCK_ROWS)))
    rows = rows.withColumn("block", F.pmod(F.col("first"), F.lit(blocks)).cast("int"))
    sizes = [0] * blocks
    for r in rows.groupBy("block").count().collect():  # one row per block
        sizes[r["block"]] = r["count"]
    matrix = communication_matrix(sizes, shards, seed)
    edges = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    table = spark.createDataFrame([(b, e) for b, e in enumerate(edges)], "block int, edges array<long>")
    rank = F.row_number().over(Window.partitionBy("block").orderBy("first", "id")) - 1
    dealt = rows.join(F.broadcast(table), "block").withColumn("rank", rank)
    dealt = dealt.withColumn("shard", F.size(F.filter("edges", lambda e: e <= F.col("rank"))))
    dealt = dealt.withColumn("second", F.xxhash64(F.lit(seed + 1), "first"))
    dealt = dealt.withColumn("part", F.pmod(F.shiftrightunsigned("second", 32), F.lit(parts)).cast("int"))
    dealt = dealt.select("id", "size", "text_crc32", "shard", "part", "second")
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(ahead, F.lit(0)))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("second", "id"))
    # shards * parts rows on the right side
    placed = dealt.withColumn("place", place).join(F.broadcast(before.select("shard", "part", "before")), ["shard", "part"])
    return placed.select(F.col("id").alias(id_column), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place") - 1).alias("slot"))
