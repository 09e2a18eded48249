"""Exact top-k search by integer inner product: columnar branch-and-bound.

1. Components become whole numbers, and vectors are packed into blocks of ``BLOCK`` in vertical layout (all first components, then all second ones),
   in the smallest integer type that holds them. Blocks are written once; they are what is dealt out and read, so no task's share depends on a key.
2. Blocks of queries and of candidates meet in a grid of cells: ``down`` parts of about ``ASKED`` queries, each with ``across`` parts of the candidates. A cell
   holds its queries and streams its blocks.
3. In a cell, a block's dimensions are taken heaviest first, ``STEP`` at a time. After each step a candidate can gain no more for a query than the product of
   the norms of what is left of both (the remaining mass). Pairs that can't reach the query's k-th best so far are dropped, and what survives is compacted:
   first candidates that no query needs any more, then, once few pairs are left, to a list of pairs.
4. Each cell's k best of each query go on, and the best of those are the result. Bounds err to the safe side and ties are kept, so the result is exact.

Sums are taken in doubles where no sum can pass 2**53, and in Python's integers where one could.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; vectors of different lengths don't meet (empty
ones meet, at 0); a query's own id is never among its results; rows that repeat id and vector count once, an id with several vectors may be named
once for each; ties go to the smaller id; a table with fewer candidates gives them all; components and scores beyond a long's range count as its
ends; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmerge.llm.common import shuffle_partitions, written

#: Vectors of a block, dimensions of a step, queries that are compared at once, and queries that a cell holds.
BLOCK, STEP, TOGETHER, ASKED = 1024, 8, 256, 1 << 16
#: The share of surviving pairs below which they are listed.
FEW = 0.25
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCKS = "asks boolean, width int, n int, ids binary, kind string, data binary"


def whole_numbers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) of doubles, as the smallest integers that hold them all."""
    with np.errstate(over="ignore"):
        x = np.floor(values * scale)
    if not x.size:
        return x.astype("<i2")
    most = np.abs(x).max()
    if most < 1 << 62:
        return x.astype(next(t for t, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < top))
    return np.array([min(MOST, max(LEAST, int(v))) if math.isfinite(v) else (MOST if v > 0 else LEAST) for v in x.ravel()], "<i8").reshape(x.shape)


def _blocks(rows: DataFrame, scale: float) -> DataFrame:
    """Blocks of (id, asks, vector), those of queries beside those of all."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def cut(key: tuple[bool, int], least: int) -> Iterator[pa.RecordBatch]:
            ids, matrix = np.concatenate([i for i, _ in held[key]]), np.concatenate([m for _, m in held[key]])
            at = 0
            while len(ids) - at >= least and at < len(ids):
                part = whole_numbers(matrix[at : at + BLOCK], scale)
                row = (key[0], key[1], len(part), ids[at : at + BLOCK].tobytes(), part.dtype.str, np.ascontiguousarray(part.T).tobytes())
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)
                at += BLOCK
            held[key] = [(ids[at:], matrix[at:])]

        for batch in batches:
            ids, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            offsets, values = np.asarray(batch.column(2).offsets), batch.column(2).values.to_numpy()
            lengths = np.diff(offsets)
            for width in np.unique(lengths):
                for side in (False, True):
                    own = np.flatnonzero((lengths == width) & (asks if side else True))
                    if len(own):
                        held.setdefault((side, int(width)), []).append((ids[own], values[offsets[own][:, None] + np.arange(width)].astype(np.float64)))
                        if sum(len(i) for i, _ in held[side, int(width)]) >= BLOCK:
                            yield from cut((side, int(width)), BLOCK)
        for key in held:
            yield from cut(key, 1)

    schema = pa.schema([("asks", pa.bool_()), ("width", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("data", pa.binary())])
    return written(rows.mapInArrow(pack, BLOCKS).withColumn("block", F.monotonically_increasing_id()))


class Best:
    """The k best candidates seen so far of each of some queries of one length; ``columns`` has a row for each dimension."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, k: int):
        self.ids, self.whole, self.k = ids, columns, k
        self.columns, self.squares = columns.astype(np.float64), columns.astype(np.float64) ** 2
        self.most = max((abs(int(columns.min())), abs(int(columns.max())))) if columns.size else 0
        self.found = np.zeros((0, 3), np.int64)  # query's place, score, id: best first within each query
        self.least = np.full(len(ids), -np.inf)
        #: multiplications that were made, of all that a plain search makes
        self.made = self.all = 0

    def see(self, ids: np.ndarray, columns: np.ndarray) -> None:
        """Compares all queries with a block."""
        width, n = columns.shape
        self.all += width * n * len(self.ids)
        most = max((abs(int(columns.min())), abs(int(columns.max())))) if columns.size else 0
        if most * self.most * width >= 1 << 53:
            self._exactly(ids, columns)
            return
        x = columns.astype(np.float64)
        squares = x**2
        order = np.argsort(-(squares.sum(axis=1) * self.squares.sum(axis=1)), kind="stable")
        x, squares = x[order], squares[order]
        starts = range(0, width, STEP)
        left = [np.sqrt(squares[s + STEP :].sum(axis=0)) for s in starts]
        for low in range(0, len(self.ids), TOGETHER):
            self._branch(low, ids, x, left, order)

    def _branch(self, low: int, ids: np.ndarray, x: np.ndarray, left: list[np.ndarray], order: np.ndarray) -> None:
        q, own = self.columns[order, low : low + TOGETHER], self.squares[order, low : low + TOGETHER]
        least = self.least[low : low + TOGETHER]
        kept = np.arange(len(ids))
        sums, pairs = np.zeros((q.shape[1], len(ids))), None
        for step, at in enumerate(range(0, len(x), STEP)):
            end = min(len(x), at + STEP)
            mass = np.sqrt(own[end:].sum(axis=0))
            if pairs is None:
                sums += q[at:end].T @ x[at:end, kept]
                self.made += (end - at) * sums.size
                alive = (sums + mass[:, None] * left[step][kept]) * (1 + 1e-9) + 1e-3 * (mass[:, None] + 1) >= least[:, None] if end < len(x) else sums >= least[:, None]
                if alive.mean() < FEW:
                    a, b = np.nonzero(alive)
                    pairs, sums = (a, kept[b]), sums[a, b]
                elif not (wanted := alive.any(axis=0)).all():
                    kept, sums = kept[wanted], np.ascontiguousarray(sums[:, wanted])
            else:
                a, b = pairs
                for d in range(at, end):
                    sums += q[d, a] * x[d, b]
                self.made += (end - at) * len(a)
                upper = (sums + mass[a] * left[step][b]) * (1 + 1e-9) + 1e-3 * (mass[a] + 1) if end < len(x) else sums
                alive = upper >= least[a]
                pairs, sums = (a[alive], b[alive]), sums[alive]
        if pairs is None:
            a, b = np.nonzero(sums >= least[:, None])
            pairs, sums = (a, kept[b]), sums[a, b]
        self._keep(pairs[0] + low, sums.astype(np.int64), ids[pairs[1]])

    def _exactly(self, ids: np.ndarray, columns: np.ndarray) -> None:
        x = columns.astype(object)
        for q in range(len(self.ids)):
            sums = sum((int(self.whole[d, q]) * x[d] for d in range(len(x))), np.zeros(len(ids), object))
            self._keep(np.full(len(ids), q), np.array([min(MOST, max(LEAST, s)) for s in sums], np.int64), ids)

    def _keep(self, places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.ids[places]
        told = np.stack([places[other], scores[other], ids[other]], axis=1)
        mine = np.isin(self.found[:, 0], np.unique(places))
        rows = np.concatenate([self.found[mine], told])
        rows = rows[np.lexsort((rows[:, 2], ~rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - first
        last = rank == self.k - 1
        self.least[rows[last, 0]] = rows[last, 1]
        self.found = np.concatenate([self.found[~mine], rows[rank < self.k]])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[self.found[:, 0]], self.found[:, 2], self.found[:, 1])], ["query_id", "id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, id, score): the k rows of highest inner product, in whole ``scale``-ths, for each row where ``is_query`` holds."""
    numbers = F.col(vector).cast("array<double>").alias("vector")
    rows = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), numbers)
    rows = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    blocks = _blocks(rows.groupBy("id", "vector").agg(F.max("asks").alias("asks")).select("id", "asks", "vector"), scale)
    there = {r["asks"]: (r["rows"], r["blocks"]) for r in blocks.groupBy("asks").agg(F.sum("n").alias("rows"), F.count("*").alias("blocks")).collect()}
    down = math.ceil(there.get(True, (1, 0))[0] / ASKED)
    across = max(1, min(there.get(False, (0, 1))[1], math.ceil(2 * shuffle_partitions(vectors.sparkSession) / down)))

    def dealt(side: bool, own: int, others: int, cell) -> DataFrame:
        """Each block in its own part, for each part of the other side."""
        part = F.pmod(F.xxhash64("block"), F.lit(own)).cast("int")
        return blocks.filter(F.col("asks") == side).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda other: cell(part, other))))

    both = dealt(True, down, across, lambda mine, other: other * down + mine).unionByName(dealt(False, across, down, lambda mine, other: mine * down + other))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, waiting = None, {}, {}
        for batch in batches:
            for cell, asks, width, ids, kind, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if cell != now:
                    yield from (b.batch() for b in best.values())
                    now, best, waiting = cell, {}, {}
                names = np.frombuffer(ids, "<i8")
                columns = np.frombuffer(data, kind).reshape(width, len(names))
                if asks:
                    waiting.setdefault(width, []).append((names, columns))
                else:
                    if width in waiting:
                        own = waiting.pop(width)
                        best[width] = Best(np.concatenate([i for i, _ in own]), np.concatenate([c for _, c in own], axis=1), k)
                    if width in best:
                        best[width].see(names, columns)
        yield from (b.batch() for b in best.values())

    dealt_out = both.select("cell", "asks", "width", "ids", "kind", "data", "block").repartition("cell").sortWithinPartitions("cell", F.desc("asks"), "block")
    found = dealt_out.drop("block").mapInArrow(search, "query_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
