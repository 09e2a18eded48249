"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

1. Rows of one vector form a class (its smallest ids are kept, one more than the neighbours wanted), so a very common vector is one entry.
2. A table's hash rotates the unit vector by three rounds of random signs and a fast Hadamard transform, and takes the nearest signed axis;
   ``functions`` such hashes make a bucket, by default one, whatever the number of rows.
3. Each class goes to its bucket in each table. A query goes to the ``probes`` buckets of each table whose axes lie nearest to it, by default
   to a fixed share of all buckets (``shared_probes``). So neither more rows nor longer hashes or vectors make it search a smaller share.
4. Where both meet, distances are taken on the original vectors in double precision, and each query's nearest go on. A bucket of more vectors
   than half a task's share (``SPLIT`` at most) or over ``ASKED`` queries is cut by hash into a grid of parts; vectors go to each part of the queries, and queries to each part
   of the vectors. A task holds one part's queries and streams its vectors. Pairs are never listed.
5. A query that found fewer than it should is searched again in all buckets of one table, so over all rows; ``again`` marks its rows.

Cases: vectors that are null, empty or zero, or hold a null or non-finite component, take no part; vectors of different lengths don't meet; rows that
repeat an id with its vector count once; ties go to the smaller id; a table with fewer candidates gives them all; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmerge.llm.common import shuffle_partitions, written
from colmerge.llm.textvec import mix

TABLES, PROBES, CHUNK, BLOCK = 4, 32, 8192, 1024
#: Vectors of a bucket beyond which it is cut: half of a task's share of all, but within these bounds; and queries.
LEAST_SPLIT, SPLIT, ASKED = 512, 1 << 18, 1 << 15
#: The share of a table's buckets that a query goes to, and that for vectors of more than ``NARROW`` axes, which need more for the same recall.
SHARE, WIDE_SHARE, NARROW = 0.25, 0.4, 128


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, whose length is a power of two, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def axis_scores(vectors: np.ndarray, table: int, function: int, seed: int) -> np.ndarray:
    """How near each unit vector, rotated, lies to each of the signed axes; larger is nearer."""
    size = 1 << max(0, vectors.shape[1] - 1).bit_length()
    x = np.zeros((len(vectors), size))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, table, function, size])
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], size))
    return np.concatenate([x, -x], axis=1)


def shared_probes(width: int, functions: int) -> int:
    """The buckets of a table that a query of ``width`` components goes to, unless the caller names a number."""
    axes = 2 << max(0, width - 1).bit_length()
    return max(PROBES, math.ceil((SHARE if axes <= NARROW else WIDE_SHARE) * axes**functions))


def bucket_keys(vectors: np.ndarray, table: int, functions: int, probes: int, seed: int) -> np.ndarray:
    """Keys of the ``probes`` nearest buckets of each vector, nearest first (all buckets, if there are fewer)."""
    best = np.zeros((len(vectors), 1))
    code = np.full((len(vectors), 1), mix(np.array([table * 1_000_003 + vectors.shape[1]], np.uint64), 31)[0])
    for f in range(functions):
        scores = axis_scores(vectors, table, f, seed)
        take = min(probes, scores.shape[1])
        axes = np.argsort(-scores, axis=1, kind="stable")[:, :take]
        loss = scores.max(axis=1, keepdims=True) - np.take_along_axis(scores, axes, axis=1)
        total = (best[:, :, None] + (loss**2)[:, None, :]).reshape(len(vectors), -1)
        codes = mix((code[:, :, None] ^ mix(axes.astype(np.uint64), 32 + f)[:, None, :]).reshape(len(vectors), -1), 33)
        order = np.argsort(total, axis=1, kind="stable")[:, :probes]
        best, code = np.take_along_axis(total, order, axis=1), np.take_along_axis(codes, order, axis=1)
    return code.astype(np.int64)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the list column, for each length of vector in it."""
    offsets, values = np.asarray(column.offsets), column.values.to_numpy()
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[offsets[rows][:, None] + np.arange(n)]


def _packed(column: pa.Array) -> pa.Array:
    """The components of each list as bytes."""
    values = column.values.to_numpy()
    ends = np.asarray(column.offsets).astype(np.int64) * values.itemsize
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(values)])
    return whole.cast(pa.binary())


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """Packed vectors of one length as a matrix of doubles."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(kind).reshape(len(column), -1).astype(np.float64)


def _keyed(classes: DataFrame, tables: int, functions: int, probes: int | None, seed: int) -> DataFrame:
    """(class, keys, vector): the buckets of each class, and its vector's components packed as they are stored. Hashed once, and written."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[list[int]] = [[]] * batch.num_rows
            for rows, matrix in _matrices(batch.column(1)):
                most = shared_probes(matrix.shape[1], functions) if probes is None else probes
                block = max(1, (1 << 22) // (most * 2 << max(0, matrix.shape[1] - 1).bit_length())) if functions > 1 else CHUNK
                for low in range(0, len(rows), block):
                    part = matrix[low : low + block].astype(np.float64)
                    found = np.concatenate([bucket_keys(part, t, functions, most, seed) for t in range(tables)], axis=1)
                    for r, k in zip(rows[low : low + block], found.tolist(), strict=True):
                        keys[r] = k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), _packed(batch.column(1))], ["class", "keys", "vector"])

    return written(classes.select("class", "vector").mapInArrow(hashed, "class long, keys array<long>, vector binary"))


class _Best:
    """The nearest of the candidates seen so far in one bucket, for each of its queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        squares, own = (vectors**2).sum(axis=1), (self.vectors**2).sum(axis=1)
        slack = 1e-9 * (own + squares.max(initial=0.0)) + 1e-300
        for q in range(len(self.ids)):
            if q % BLOCK == 0:
                rough = own[q : q + BLOCK, None] + squares - 2 * self.vectors[q : q + BLOCK] @ vectors.T
            row, near = rough[q % BLOCK], np.arange(len(ids))
            if len(ids) > self.k:
                near = np.flatnonzero(row <= np.partition(row, self.k - 1)[self.k - 1] + slack[q])
            far, names = self.found[q]
            far = np.concatenate([far, np.sqrt(((vectors[near] - self.vectors[q]) ** 2).sum(axis=1))])
            names = np.concatenate([names, ids[near]])
            first = np.lexsort((names, far))[: self.k]
            self.found[q] = far[first], names[first]

    def batch(self) -> pa.RecordBatch:
        times = [len(x) for x, _ in self.found]
        far = np.concatenate([x for x, _ in self.found] or [np.zeros(0)])
        names = np.concatenate([x for _, x in self.found] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, times), pa.int64()), pa.array(names, pa.int64()), pa.array(far)], ["query", "class", "score"])


def _met(queries: DataFrame, candidates: DataFrame, k: int, kind: type) -> DataFrame:
    """(query, class, score): for each bucket and query in it, the k nearest candidates there."""

    def sizes(rows: DataFrame, name: str, most: int) -> DataFrame:
        counts = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        return counts.filter(F.col("n") > most).select("key", F.ceil(F.col("n") / F.lit(most)).cast("int").alias(name))

    share = candidates.select(F.sum(F.size("keys"))).first()[0] or 0
    most = min(SPLIT, max(LEAST_SPLIT, share // (2 * shuffle_partitions(candidates.sparkSession))))
    grid = sizes(candidates, "across", most).join(sizes(queries, "down", ASKED), "key", "full")
    across, down = F.coalesce("across", F.lit(1)), F.coalesce("down", F.lit(1))

    def dealt(rows: DataFrame, own: Column, others: Column, cell) -> DataFrame:
        """Each row in its own part, for each part of the other side."""
        spread = rows.select(F.explode("keys").alias("key"), "class", "vector").join(grid, "key", "left")
        part = F.transform(F.sequence(F.lit(0), others - 1), lambda other: cell(F.pmod(F.xxhash64("class"), own).cast("int"), other))
        return spread.select("key", F.explode(part).alias("part"), "class", "vector")

    left = dealt(queries, down, across, lambda mine, other: other * down + mine).withColumn("side", F.lit(0))
    right = dealt(candidates, across, down, lambda mine, other: mine * down + other).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("key", "part", "side", "class", "vector")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, waiting = None, None, []
        for batch in batches:
            key, part, side = (batch.column(c).to_numpy() for c in range(3))
            ids = batch.column(3).to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if at == end:
                    continue
                if (key[at], part[at]) != now:
                    if best:
                        yield best.batch()
                    now, best, waiting = (key[at], part[at]), None, []
                for low in range(at, end, CHUNK):
                    high = min(end, low + CHUNK)
                    matrix = _unpacked(batch.column(4).slice(low, high - low), kind)
                    if side[at] == 0:
                        waiting.append((ids[low:high], matrix))
                    elif waiting or best:
                        if waiting:
                            best, waiting = _Best(np.concatenate([x for x, _ in waiting]), np.concatenate([m for _, m in waiting]), k), []
                        best.see(ids[low:high], matrix)
        if best:
            yield best.batch()

    grouped = both.repartition("key", "part").sortWithinPartitions("key", "part", "side")
    return grouped.mapInArrow(rank, "query long, class long, score double")


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int | None = None, functions: int = 1, seed: int = 13) -> DataFrame:
    """(query_id, rank, id, score, again): the k nearest rows found for each row where ``is_query`` holds, by Euclidean distance."""
    stored = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    kind = np.float32 if stored == "array<float>" else np.float64
    rows = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(stored).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(_usable(F.col("vector"))).groupBy("vector", "id").agg(F.max("asks").alias("asks"))
    ordered = Window.partitionBy("vector").orderBy("id")
    first = rows.withColumn("place", F.row_number().over(ordered)).filter(F.col("place") <= k + 1)
    classes = written(first.groupBy("vector").agg(F.min("id").alias("class"), F.array_sort(F.collect_list("id")).alias("members")))
    asking = written(rows.filter("asks").join(classes.select("vector", "class"), "vector").select("id", "class"))
    queries = asking.select("class").distinct().join(classes.select("class", "vector"), "class")
    met = _met(_keyed(queries, tables, functions, probes, seed), _keyed(classes, tables, functions, 1, seed), k + 1, kind)

    def nearest(found: DataFrame) -> DataFrame:
        """(class, id, score): the k + 1 nearest rows of each query's class."""
        near = found.dropDuplicates(["query", "class"]).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "class"))).filter(F.col("n") <= k + 1)
        members = near.join(classes.select("class", "members"), "class").select(F.col("query").alias("class"), "score", F.explode("members").alias("id"))
        return members.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("score", "id"))).filter(F.col("n") <= k + 1).select("class", "id", "score")

    told = written(nearest(met))
    sizes = classes.select(F.size("vector").alias("width"), F.size("members").alias("n")).groupBy("width").agg(F.sum("n").alias("there"))
    counts = told.groupBy("class").agg(F.count("*").alias("n"))
    wanted = queries.select("class", F.size("vector").alias("width")).join(sizes, "width").join(counts, "class", "left")
    short = written(wanted.filter(F.coalesce("n", F.lit(0)) < F.least("there", F.lit(k + 1))).select("class"))
    told = told.withColumn("again", F.lit(False))
    if not short.isEmpty():
        repeated = queries.join(short, "class", "left_semi")
        every = 2 * (1 << max(0, (classes.agg(F.max(F.size("vector"))).first()[0] or 1) - 1).bit_length())
        more = nearest(_met(_keyed(repeated, 1, 1, every, seed), _keyed(classes, 1, 1, 1, seed), k + 1, kind))
        told = told.join(short, "class", "left_anti").unionByName(more.withColumn("again", F.lit(True)))
    pairs = asking.select(F.col("id").alias("query_id"), "class").join(told, "class").filter("query_id <> id")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).filter(F.col("rank") <= k)
    return pairs.select("query_id", "rank", F.col("id").alias(id_column), "score", "again")
