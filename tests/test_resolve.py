"""Conflict rules: stated cases, algebra under shuffled and repeated delivery, and the two modes."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colmerge.operators.delta import changes_since, fan_out, next_version, pack, received, unpack
from colmerge.operators.notify import notifications
from colmerge.operators.replay import replay
from colmerge.operators.resolve import converged, liveness, materialize, valid, winners
from colmerge.operators.state import applied, applied_cells, compact, merge
from colmerge.sources.tables import ADD_WINS, CHANGELOG, DELETE_WINS, TOMBSTONE, Registry, SnapshotStore, TableMeta, from_wire, meta_put, rejected_lines, to_wire

TASKS = TableMeta("tasks", "id", ("id", "title", "done"), required=("title", "done"))
NAMES = [f.name for f in CHANGELOG]


def cell(pk, cid, val, site, version, db_version=1, tbl="tasks"):
    return (tbl, pk, cid, val, site, version, version, 0, db_version)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGELOG)


def titles(df):
    return {r["pk"]: r["title"] for r in materialize(df, ["title"], DELETE_WINS).collect()}


@pytest.mark.parametrize(
    ("one", "two", "wins"),
    [
        (("z", "A", 3), ("a", "B", 5), "a"),  # a higher version, whatever the values
        (("z", "A", 3), ("a", "B", 3), "z"),  # then larger bytes
        (("a", "A", 3), ("a", "B", 3), "a"),
        (("Eggs", "A", 1), ("Bread", "B", 1), "Eggs"),
        ((None, "B", 1), ("", "A", 1), ""),  # absent is smallest
    ],
)
def test_winner(spark, one, two, wins):
    both = log(spark, *[cell("r", "title", v, s, n) for v, s, n in (one, two)])
    row = winners(both).first()
    assert row["val"] == wins
    assert row["site_id"] == max((one, two), key=lambda c: (c[2], c[0] is not None, c[0] or "", c[1]))[1]


@pytest.mark.parametrize(("cl", "policy", "alive"), [(10, DELETE_WINS, False), (3, DELETE_WINS, True), (10, ADD_WINS, False), (3, ADD_WINS, True), (5, DELETE_WINS, False), (5, ADD_WINS, True)])
def test_delete(spark, cl, policy, alive):
    changes = log(spark, cell("r", "title", "x", "A", 5), cell("r", TOMBSTONE, None, "B", cl))
    assert liveness(changes, policy).first()["alive"] is alive
    assert (converged(changes, policy).count() == 1) is alive


def test_tie_of_two_and_three_sites(spark):
    assert titles(log(spark, cell("t", "title", "A-value", "A", 1), cell("t", "title", "B-value", "B", 1))) == {"t": "B-value"}
    assert titles(log(spark, *[cell("t", "title", f"{s}-wins", s, 2) for s in "ABC"])) == {"t": "C-wins"}


def test_last_of_many_updates_and_insert_then_delete(spark):
    assert titles(log(spark, *[cell("t", "title", f"v{k}", "A", k) for k in range(1, 11)])) == {"t": "v10"}
    assert titles(log(spark, cell("t", "title", "x", "A", 1), cell("t", TOMBSTONE, None, "A", 2))) == {}


def test_insert_after_delete(spark):
    changes = log(spark, cell("t", "title", "x", "A", 1), cell("t", TOMBSTONE, None, "A", 5), cell("t", "title", "Reinserted", "A", 10))
    assert titles(changes) == {"t": "Reinserted"}


def test_guards(spark):
    changes = log(spark, cell("t", "title", "x", "A", 1), cell("t", "colour", "x", "A", 1), cell("t", "id", "x", "A", 1), cell("t", "title", "x", "A", 1, tbl="other"), cell("t", TOMBSTONE, None, "A", 1))
    assert {r["cid"] for r in valid(changes, Registry(TASKS)).collect()} == {"title", TOMBSTONE}


changes = st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from(["title", "done", TOMBSTONE]), st.sampled_from([None, "a", "b"]), st.sampled_from("AB"), st.integers(1, 3), st.integers(1, 4)), min_size=1, max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(changes)
def test_order_and_repetition_do_not_matter(spark, rows):
    rows = [cell(p, c, None if c == TOMBSTONE else v, s, n, d) for p, c, v, s, n, d in rows]
    again = rows + random.Random(1).sample(rows, len(rows) // 2)
    random.Random(2).shuffle(again)
    one, two = log(spark, *rows), log(spark, *again)
    for f in (winners, lambda x: liveness(x, ADD_WINS), lambda x: merge(x, x)):
        assert sorted(map(str, f(one).collect())) == sorted(map(str, f(two).collect()))
    cut = len(rows) // 2
    if cut:
        a, b = log(spark, *rows[:cut]), log(spark, *rows[cut:])
        whole = sorted(map(str, merge(a, b).collect()))
        assert whole == sorted(map(str, merge(b, a).collect())) == sorted(map(str, merge(one, b).collect()))


def test_delta_completes_state(spark):
    rows = [cell(f"r{k % 7}", "title", str(k % 5), "AB"[k % 2], k % 4 + 1, k) for k in range(60)]
    whole = log(spark, *rows)
    state = whole.filter("db_version <= 30")
    assert sorted(map(str, winners(merge(state, changes_since(whole, 30))).collect())) == sorted(map(str, winners(whole).collect()))
    outcomes = {r["outcome"] for r in applied_cells(state, state).collect()}
    assert outcomes == {"same"}
    assert sorted(map(str, unpack(pack(whole, 10)).select("pk", "val").collect())) == sorted(map(str, whole.select("pk", "val").collect()))


def test_notifications(spark):
    state = log(spark, cell("a", "title", "x", "A", 1), cell("b", "title", "x", "A", 1))
    delta = log(spark, cell("a", "title", "y", "A", 2), cell("b", TOMBSTONE, None, "A", 2), cell("c", "title", "n", "A", 1), cell("b", TOMBSTONE, None, "A", 2))
    told = {r["pk"]: (r["kind"], r["changed_columns"]) for r in notifications(state, delta, DELETE_WINS).collect()}
    assert told == {"a": ("Update", "title"), "b": ("Delete", None), "c": ("Insert", "title")}
    assert notifications(merge(state, delta), delta, DELETE_WINS).count() == 0


def arriving(spark, *rows):
    return spark.createDataFrame(list(rows), "tbl string, pk string, cid string, val string, site_id string, col_version long, cl long, seq int, db_version long, arrival long")


def replayed(spark, *rows, meta=TASKS):
    return {(r["pk"], r["cid"]): (r["val"], r["col_version"]) for r in replay(arriving(spark, *rows), Registry(meta)).collect()}


def test_replay_defers_incomplete_rows(spark):
    update = (*cell("t", "title", "Updated", "A", 2), 1)
    full = [(*cell("t", "title", "Original Title", "A", 1), 2), (*cell("t", "done", "0", "A", 1), 2)]
    assert replayed(spark, update) == {}
    assert replayed(spark, update, *full) == {("t", "title"): ("Original Title", 1), ("t", "done"): ("0", 1)}


def test_replay_delete_takes_its_group_and_forgets_clocks(spark):
    loose = TableMeta("tasks", "id", ("id", "title", "done"))
    born = (*cell("t", "title", "x", "A", 4), 1)
    gone = (*cell("t", TOMBSTONE, None, "A", 5), 2)
    assert replayed(spark, born, gone, (*cell("t", "title", "sibling", "A", 9), 2), meta=loose) == {}
    # the order-free rule keeps the row dead; in order, an old version comes back
    late = (*cell("t", "title", "late", "A", 2), 3)
    assert replayed(spark, born, gone, late, meta=loose) == {("t", "title"): ("late", 2)}
    assert titles(log(spark, born[:-1], gone[:-1], late[:-1])) == {}


def test_modes_agree_without_deletes_and_partial_rows(spark):
    loose = TableMeta("tasks", "id", ("id", "title", "done"))
    rows = [cell(f"r{k % 5}", ["title", "done"][k % 2], str(k * 7 % 11), "ABC"[k % 3], k % 4 + 1, k) for k in range(80)]
    order = list(range(80))
    random.Random(4).shuffle(order)
    got = replayed(spark, *[(*rows[k], n) for n, k in enumerate(order)], meta=loose)
    assert got == {(r["pk"], r["cid"]): (r["val"], r["col_version"]) for r in winners(log(spark, *rows)).collect()}


def test_wire_meta_and_snapshots(spark, tmp_path):
    rows = log(spark, cell("a|b", "title", 'x"y', "A", 1), cell("a", TOMBSTONE, None, "A", 2))
    assert sorted(map(str, from_wire(to_wire(rows)).collect())) == sorted(map(str, rows.collect()))
    lines = spark.createDataFrame([("no json",), ('{"tbl": "t"}',), ("[1]",), (None,)], "value string").unionByName(to_wire(rows))
    assert from_wire(lines).count() == 2
    assert sorted((r["reason"], r["value"] or "") for r in rejected_lines(lines).collect()) == [("empty", ""), ("no key", '{"tbl": "t"}'), ("no object", "[1]"), ("no object", "no json")]
    line = to_wire(rows).first()["value"]
    for old, new, reason in (('"col_version":1', '"col_version":"abc"', "unreadable"), ('"cl":1', '"cl":{}', "unreadable"), ('"col_version":1', '"col_version":null', "no version"), ('"site_id":"A"', '"site_id":null', "no version")):
        assert old in line
        bad = spark.createDataFrame([(line.replace(old, new),)], "value string")
        assert from_wire(bad).count() == 0 and [r["reason"] for r in rejected_lines(bad).collect()] == [reason]
    meta = meta_put(meta_put(spark.createDataFrame([], "key string, value string"), "k", "1"), "k", "2")
    assert [tuple(r) for r in meta.collect()] == [("k", "2")]
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.read() is None
    assert (store.write(rows), store.write(compact(rows, DELETE_WINS))) == (0, 1)
    assert store.current() == 1


def shown(store):
    return sorted(map(str, store.read().collect()))


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path):
    one, two, three = (log(spark, *[cell(f"r{k}", "title", f"{name}{k}", "A", n) for k in range(20)]) for n, name in enumerate(("a", "b", "c"), 1))
    store = SnapshotStore(spark, str(tmp_path / "s"), parts=4)
    assert (store.read(), store.current(), store.write(one), store.current()) == (None, None, 0, 0)
    before = shown(store)
    # the data are there, the pointer is not
    (tmp_path / "s" / "data-0000").mkdir()
    two.write.mode("overwrite").parquet(str(tmp_path / "s" / "data-0000" / "__part=0"))
    assert shown(SnapshotStore(spark, store.path, 4)) == before
    # the pointer is begun, and has its line but not the marker of success
    broken = tmp_path / "s" / "pointer-000000000001-0000"
    broken.mkdir()
    assert shown(store) == before and store.current() == 0
    (broken / "part-00000.txt").write_text('{"snapshot": 1, "schema": {}, "parts": {}}')
    assert shown(store) == before
    # the next write takes effect, whatever lies about
    assert store.write(two) == 1 and shown(store) == sorted(map(str, two.collect()))
    assert store.write(three) == 2
    store.vacuum()
    assert shown(store) == sorted(map(str, three.collect())) and len(list((tmp_path / "s").glob("data-*"))) == 2 and store.write(one) == 3


def test_parts_are_written_apart(spark, tmp_path):
    rows = log(spark, *[cell(f"r{k}", "title", "x", "A", 1) for k in range(40)])
    store = SnapshotStore(spark, str(tmp_path / "s"), parts=4)
    store.write(rows)
    old = store._pointer()["parts"]
    mine = rows.filter(store.part() == 2)
    store.write(mine.withColumn("val", F.lit("y")), [2])
    new = store._pointer()["parts"]
    assert {k for k in old if old[k] != new[k]} == {"2"}
    assert store.read().filter("val = 'y'").count() == mine.count() == store.read([2]).count() and store.read().count() == 40
    store.write(rows.limit(0), [2])
    assert store.read([2]).count() == 0 and store.read().count() == 40 - mine.count()


def test_received_changes_get_one_version(spark):
    state, delta = log(spark, cell("a", "title", "x", "A", 1, 9)), log(spark, cell("b", "title", "x", "B", 4, 77), cell("c", "title", "x", "B", 4, 78))
    kept = merge(state, received(state, delta))
    assert {r["pk"]: r["db_version"] for r in kept.collect()} == {"a": 9, "b": 10, "c": 10}
    assert next_version(kept).first()[0] == 11 and changes_since(kept, 9).count() == 2
    dead = log(spark, cell("a", TOMBSTONE, None, "B", 3))
    assert [(r["pk"], r["cid"]) for r in applied(state, dead, ADD_WINS).collect()] == [("a", TOMBSTONE)]


def test_fan_out_and_empty(spark):
    sets = spark.createDataFrame([("A", 1), ("B", 1)], "site_id string, changeset long")
    peers = spark.createDataFrame([("p", "A", False, False), ("q", "C", False, False), ("r", "D", True, False)], "peer_id string, site_id string, infrastructure boolean, rejected boolean")
    assert {(r["site_id"], r["peer_id"]) for r in fan_out(sets, peers).collect()} == {("B", "p"), ("A", "q"), ("B", "q")}
    none = spark.createDataFrame([], CHANGELOG)
    assert [f(none).count() for f in (winners, lambda x: converged(x, ADD_WINS), lambda x: merge(x, x), lambda x: notifications(x, x, ADD_WINS))] == [0, 0, 0, 0]
    assert replay(arriving(spark), Registry(TASKS)).count() == 0
