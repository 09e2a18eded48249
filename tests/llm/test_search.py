"""Exact search against plain integer arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colmerge.llm import exact_search
from colmerge.llm.exact_search import LEAST, MOST, Best, top_k, whole_numbers

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score long, id string, block long"


def whole(x):
    return max(LEAST, min(MOST, math.floor(1024 * x) if math.isfinite(1024 * x) else (MOST if x > 0 else LEAST)))


def brute(rows, asks, k=10):
    """(query, rank, id, score) over distinct usable rows (id, vector)."""
    good = {(i, tuple(map(whole, v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    found = {}
    for q, a in good:
        if asks(q):
            found.setdefault(q, []).extend((-max(LEAST, min(MOST, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in good if i != q and len(a) == len(b))
    return sorted((q, n + 1, i, -s) for q, told in found.items() for n, (s, i) in enumerate(sorted(told)[:k]))


def searched(spark, rows, asks=lambda c: c % 3 == 0, k=10):
    table = spark.createDataFrame([(i, v, 1, 2, 3, "clash", 4) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(table, asks(F.col("vec_id")), k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(exact_search, "BLOCK", 16)
    monkeypatch.setattr(exact_search, "ASKED", 20)
    monkeypatch.setattr(exact_search, "TOGETHER", 7)


def test_equals_brute_force_with_ties_copies_and_lengths(spark, small_blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a common vector
    rows += [(300 + i, rng.integers(-2, 3, 20).astype(float).tolist()) for i in range(40)] + [(400 + i, rng.normal(size=3).tolist()) for i in range(9)]
    rows += [rows[5], rows[5], (6, rows[7][1])]  # a repeated row; an id with a second vector
    assert searched(spark, rows) == brute(rows, lambda q: q % 3 == 0)
    assert searched(spark, rows, k=1) == brute(rows, lambda q: q % 3 == 0, 1)


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (3, [0.0, 0.0]), (1, None), (2, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [9.0, 9.0]), (6, []), (7, []), (9, [5.0])]
    assert searched(spark, rows) == brute(rows, lambda q: q % 3 == 0) == [(0, 1, 3, 0), (3, 1, 0, 0), (6, 1, 7, 0)]
    assert searched(spark, []) == []
    assert searched(spark, rows[1:2]) == []


def test_large_numbers_are_exact(spark):
    big = [1e14, -3e15, 7e13 + 1 / 1024]
    rows = [(0, big), (1, [x / 7 for x in big]), (2, [1e300, 1.0, 2.0]), (3, [-1e308, 1.7e308, 0.5]), (4, [1e-300, -1e-300, 0.0])]
    assert searched(spark, rows) == brute(rows, lambda q: q % 3 == 0)


def test_bounds_spare_work_and_lose_nothing():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(8, 64))
    x = whole_numbers(middles[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 64)) * 0.3, 1024.0).astype(np.int64)
    ids = rng.permutation(4000)
    best = Best(ids[:100], np.ascontiguousarray(x[:100].T), 10)
    for low in range(0, 4000, 500):
        best.see(ids[low : low + 500], np.ascontiguousarray(x[low : low + 500].T))
    assert best.made < 0.8 * best.all
    scores = x[:100] @ x.T
    for q in range(100):
        told = sorted((-s, i) for s, i in zip(scores[q].tolist(), ids.tolist(), strict=True) if i != ids[q])[:10]
        assert [(-s, i) for p, s, i in best.found.tolist() if p == q] == told
