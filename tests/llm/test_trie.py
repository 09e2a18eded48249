"""The prefix trie against a direct version with tuples of turns as keys."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colmerge.llm import prefix_trie as P
from colmerge.llm.queries import queries

SCHEMA = "conv_id long, turn long, role string, text string, c string, depth int, x double"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    return {c: turns.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + own[h:] for c, own in turns.items()}


def brute(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    inner = {n[:-1] for n in members if n}
    out = {n: [0, 0, 0] for n in members}  # children, leaves, saved
    for n, own in members.items():
        if n:
            out[n[:-1]][0] += 1
        saved = (len(own) - 1) * (len(n[-1][1].encode()) if n else 0)
        for d in range(len(n) + 1):
            out[n[:d]][1] += n not in inner
            out[n[:d]][2] += saved
    told = []
    for n, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(n))
        told.append((min(own), len(n), min(members[n[:-1]]) if n else None, len(own), *out[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(told, key=str)


def trie(spark, rows):
    table = spark.createDataFrame([(*r, "clash", 1, 0.5) for r in rows], SCHEMA)
    shared = F.crc32(F.col("c").cast("string").cast("binary")) % 9
    got = P.prefix_trie(P.sequences(P.ordered_turns(table), shared, F.col("c") - F.col("c") % 5, most=8))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(rng, n, longest=10):
    return [(c, k, rng.choice(["user", "model", None]), rng.choice(["", "a", "b", "é", None])) for c in rng.sample(range(5 * n), n) for k in range(rng.randint(1, longest))]


def test_nulls_ties_copies_and_absent_bases(spark):
    rng = random.Random(1)
    rows = conversations(rng, 60) + [(7, None, "user", "z"), (7, None, "user", "y"), (7, None, "user", "y"), (7, 3, None, None), (None, 1, "user", "q"), (-3, 0, "a", "b"), (-5, 0, "a", "b")]
    rows += [(1000 + k, 0, "user", "hello") for k in range(200)]  # a common conversation
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert trie(spark, rows) == brute(rebuilt(rows))
    assert trie(spark, []) == []
    assert trie(spark, [(3, 1, None, None)]) == brute(rebuilt([(3, 1, None, None)]))


def test_long_conversations_in_units(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    rng = random.Random(2)
    rows = conversations(rng, 25, 40) + [(500, k, "user", "same") for k in range(60)] + [(505, k, "user", "same") for k in range(45)]

    def whole(table):
        return sorted((tuple(r) for r in P.prefix_trie(P.sequences(P.ordered_turns(table)), unit=4).collect()), key=str)

    got = whole(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    turns = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert got == brute(turns)


def test_node_table_is_minimal_and_verified():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    table = P.NodeTable(keys)
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (table.slots(keys ^ np.uint64(1)) == -1).all()
    assert P.NodeTable(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_equal_digests_are_found_out(spark, monkeypatch):
    seen = []
    plain = P.paths_of

    def poor(steps, seed):
        seen.append(seed)
        out = plain(steps, seed)
        return out.withColumns({"x": F.col("x") % 2, "y": F.lit(0).cast("long")}) if seed < 2 else out

    monkeypatch.setattr(P, "paths_of", poor)
    rows = [(c, k, "user", f"{c}:{k}") for c in range(0, 50, 5) for k in range(3)]
    assert trie(spark, rows) == brute(rebuilt(rows))
    assert seen == [0, 1, 2]
    monkeypatch.setattr(P, "SEEDS", 2)
    with pytest.raises(ValueError, match="equal digests"):
        trie(spark, rows)


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries()["op11_prefix_trie"](spark, "/root/testdata/sf0.001").select(COLUMNS).collect()), key=str)
    assert got == brute(rebuilt(rows))
