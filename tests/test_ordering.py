"""Numbers and running values over ranges against plain loops, and how ranges split hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from colmerge.operators import metrics
from colmerge.operators.delta import in_order, pack, unpack
from colmerge.operators.ordering import counted, laid_out, numbered, placed, scanned
from colmerge.operators.stamping import stamp_deletes, stamp_writes
from colmerge.sources.tables import CHANGELOG, TOMBSTONE


@pytest.fixture
def many_ranges(spark):
    """No ranges are put together, however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def first_nulls(*values):
    return tuple((v is not None, v if v is not None else 0) for v in values)


def test_numbers_and_running_values_with_nulls_and_hot_keys(many_ranges):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), rng.choice([None, 3, -5, k]), k, rng.choice([None, k % 7])) for k in range(400)]
    table = many_ranges.createDataFrame(rows, "g int, x int, k int, v int")
    for before in (False, True):
        got = scanned(table, ["g"], ["x", "k"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v")), "n": ("sum", F.lit(1))}, before).collect()
        assert len(got) == len(rows)
        by_k = {r["k"]: r for r in got}
        for g in (None, 1, 2):
            seen = []
            own = sorted((r for r in rows if r[0] == g), key=lambda r: first_nulls(*r[1:3]))
            for n, (_, _, k, v) in enumerate(own):
                told = [x for x in seen + ([] if before else [v]) if x is not None]
                assert (by_k[k]["s"], by_k[k]["m"], by_k[k]["l"]) == ((sum(told), max(told), min(told)) if told else (None,) * 3)
                assert by_k[k]["n"] == (n if before else n + 1) or before and n == 0 and by_k[k]["n"] is None
                seen.append(v)
    got = placed(table, ["g", "x", "k"], "place").collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["place"])] == [r[2] for r in sorted(rows, key=lambda r: first_nulls(*r[:3]))]
    assert sorted(r["place"] for r in got) == list(range(1, 401))
    assert numbered(table.limit(0), ["g"], "k", "n").collect() == placed(table.limit(0), ["k"], "n").collect() == []


def test_equal_rows_get_different_numbers(many_ranges):
    table = many_ranges.createDataFrame([("a", 1)] * 50 + [("b", 1)] * 3, "g string, x int")
    got = numbered(table, ["g"], "x", "n").collect()
    assert sorted((r["g"], r["n"]) for r in got) == [("a", k) for k in range(1, 51)] + [("b", k) for k in (1, 2, 3)]


def test_one_version_and_one_prefix_are_dealt_to_all_tasks(many_ranges):
    one_version = many_ranges.range(20_000).select(F.lit(7).alias("db_version"), F.concat(F.lit("user_"), "id").alias("pk"))
    sizes = [r["count"] for r in laid_out(one_version, ["db_version", "pk"]).groupBy("__scan_part").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2 * 20_000 / 7


def test_in_order_of_a_delta_of_one_version(many_ranges):
    log = [("t", f"r{k:03}", "c", "1", "s", 1, 1, k % 3, 7) for k in range(60)] + [(None, "x", "c", None, None, 1, 1, None, 7)]
    got = in_order(many_ranges.createDataFrame(log, CHANGELOG)).collect()
    assert [r["place"] for r in got] == list(range(1, 62)) and got[0]["pk"] == "x"
    assert [(r["seq"], r["pk"]) for r in got[1:]] == sorted((k % 3, f"r{k:03}") for k in range(60))


def brute_writes(writes, known):
    statements = {o: n + 1 for n, o in enumerate(sorted({w[3] for w in writes}, key=first_nulls))}
    out, had = [], dict(known)
    for w in sorted(writes, key=lambda w: first_nulls(w[3])):
        had[w[:3]] = had.get(w[:3], 0) + 1
        out.append((*w, had[w[:3]], statements[w[3]]))
    return sorted(out, key=str)


def test_stamping_loses_no_row_to_a_null(many_ranges):
    rng = random.Random(2)
    writes = [("t", rng.choice([None, "1", "2"]), rng.choice([None, "a"]), k) for k in range(80)] + [("t", "1", "a", None), (None, None, None, 80)]
    known = {("t", "1", "a"): 5, ("t", None, None): 2}
    clock = many_ranges.createDataFrame([(*k, v) for k, v in known.items()], "tbl string, pk string, cid string, col_version long")
    table = many_ranges.createDataFrame(writes, "tbl string, pk string, cid string, event_id int")
    got = stamp_writes(table, clock).select("tbl", "pk", "cid", "event_id", "col_version", "db_version").collect()
    assert sorted(map(tuple, got), key=str) == brute_writes(writes, known)
    assert stamp_writes(table).count() == len(writes)


def test_deletes_of_a_row_with_most_of_the_log(many_ranges):
    rng = random.Random(3)
    writes = [("t", "hot" if rng.random() < 0.8 else rng.choice([None, "x"]), rng.choice(["a", "b", TOMBSTONE, None]), k) for k in range(300)]
    table = many_ranges.createDataFrame(writes, "tbl string, pk string, cid string, event_id int")
    got = sorted((r["event_id"], r["cl"], r["cleared"]) for r in stamp_deletes(table).collect())
    told, versions, most, standing = [], {}, {}, {}
    for _, pk, cid, k in writes:
        if cid == TOMBSTONE:
            standing[pk] = standing.get(pk, 0) + 1
            told.append((k, most.get(pk, 0) + standing[pk], any(p == pk and c is not None and c != TOMBSTONE for _, p, c, n in writes if n > k)))
        elif cid is not None:
            versions[pk, cid] = versions.get((pk, cid), 0) + 1
            most[pk] = max(most.get(pk, 0), versions[pk, cid])
            standing[pk] = 0
    assert got == told


def test_percentiles_of_a_hot_key_in_many_ranges(many_ranges):
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 9)) for _ in range(700)] + [("few", x) for x in (3.0, 1.0, 1.0)] + [("one", 7.0), ("none", None), (None, 2.0), (None, 4.0)] + [("ties", float(k % 3)) for k in range(90)]
    table = many_ranges.createDataFrame(rows, "g string, x double")
    at = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    told = {r["g"]: r for r in table.groupBy("g").agg(*[F.percentile("x", p).alias(name) for name, p in at.items()], F.avg("x").alias("mean"), F.max("x").alias("most")).collect()}
    got = metrics.percentiles(table, F.col("x"), at, ["g"]).collect()
    assert len(got) == len(told) == 6
    for r in got:
        assert all(r[c] == pytest.approx(told[r["g"]][c]) for c in (*at, "mean", "most"))
    ranks = {r["g"]: (r["a"], r["b"]) for r in metrics.rank_percentiles(table, "x", {"a": 50, "b": 95}, ["g"]).collect()}
    for g in told:
        own = sorted(x for k, x in rows if k == g and x is not None)
        assert ranks[g] == ((own[len(own) * 50 // 100], own[len(own) * 95 // 100]) if own else (None, None))


def test_a_bulk_insert_is_packed_in_parts(many_ranges):
    log = many_ranges.createDataFrame([("t", f"r{k}", "c", str(k), "A", 1, 1, k, 7) for k in range(95)] + [("t", "x", "c", "1", "B", 1, 1, 0, 3)], CHANGELOG)
    got = pack(log, 10, most=20)
    assert sorted((r["site_id"], r["part"], len(r["changes"])) for r in got.collect()) == [("A", 0, 20), ("A", 1, 20), ("A", 2, 20), ("A", 3, 20), ("A", 4, 15), ("B", 0, 1)]
    rows = got.filter("site_id = 'A'").orderBy("part").collect()
    assert [c["seq"] for r in rows for c in r["changes"]] == list(range(95))
    assert unpack(got).count() == 96 and pack(log, 10).count() == 2


def test_places_in_ranges_give_the_numbers_of_long_groups(many_ranges):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "b", "b", "b", ""]), rng.choice([None, 0.0, -0.0]), rng.choice([None, 3, -5, k]), k) for k in range(500)]
    table = many_ranges.createDataFrame(rows, "g string, h double, x int, k int")
    got = counted(table, ["g", "h"], ["x", "k"], "n")
    assert got.columns == ["g", "h", "x", "k", "n"] and dict(got.dtypes)["n"] == "bigint"
    of = {r["k"]: r["n"] for r in got.collect()}
    for group in {r[:2] for r in rows}:  # 0.0 and -0.0 are one
        own = sorted((r for r in rows if r[:2] == group), key=lambda r: first_nulls(*r[2:]))
        assert [of[r[3]] for r in own] == list(range(1, len(own) + 1))
    assert len(of) == 500 and counted(table.limit(0), ["g"], ["k"], "n").collect() == []
    # rows that are equal in all columns get different numbers
    same = many_ranges.range(300).select(F.lit("a").alias("g"), F.lit(1).alias("x"))
    assert sorted(r["n"] for r in counted(same, ["g"], ["x"], "n").collect()) == list(range(1, 301))
