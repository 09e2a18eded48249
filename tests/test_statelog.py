"""The log of state: levels, the ledger, what a batch writes, and notifications of batches that are handed on again."""

import random

import pytest

from colmerge.operators.state import merged
from colmerge.sources.statelog import StateLog
from colmerge.sources.tables import CHANGELOG, DELETE_WINS
from colmerge.streaming import live


def changes(rng, n, keys, first=0):
    dead = [rng.random() < 0.1 for _ in range(n)]
    return [("t", f"r{rng.randrange(keys)}", "__deleted" if dead[k] else rng.choice("ab"), None if dead[k] else str(rng.randrange(9)), rng.choice("AB"), (v := rng.randrange(1, 9)), v, 0, first + k) for k in range(n)]


def shown(df):
    return sorted(map(str, df.select("tbl", "pk", "cid", "val", "site_id", "col_version").collect()))


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_levels_hold_the_state_whole(spark, tmp_path):
    rng, rows = random.Random(1), []
    log = StateLog(spark, str(tmp_path), ratio=2, least=8, bucket_rows=16)
    assert log.read().count() == 0 and log.runs() == [] and log.committed() == -1
    for k in range(9):
        more = changes(rng, 20, 60, 20 * k)
        rows += more
        assert log.commit(spark.createDataFrame(more, CHANGELOG))
        log.fold()
        assert len({r["level"] for r in log.runs()}) == len(log.runs()) < 6  # one run a level, with a ratio of 2
    assert len(log.runs()) > 1 and max(r["buckets"] for r in log.runs()) > 1
    whole = merged(spark.createDataFrame(rows, CHANGELOG))
    assert shown(log.read()) == shown(whole)
    keys = spark.createDataFrame([("t", "r3"), ("t", "r7"), ("t", "r7"), ("t", "nobody"), (None, None)], "tbl string, pk string")
    assert shown(log.read(keys)) == shown(whole.filter("pk in ('r3', 'r7')"))
    log.commit(spark.createDataFrame([], CHANGELOG), 3, "s")
    assert log.committed("s") == 3 and shown(log.read()) == shown(whole)
    log.vacuum()
    assert shown(log.read()) == shown(whole)
    assert len(list(tmp_path.glob("pointer-*"))) == 2
    with pytest.raises(ValueError, match="ratio"):
        StateLog(spark, "x", ratio=1)


def test_a_batch_writes_as_much_over_a_large_state_as_over_a_small_one(spark, tmp_path):
    wrote = []
    for n in (2_000, 40_000):
        log = StateLog(spark, str(tmp_path / str(n)), least=1000)
        start = spark.range(n).selectExpr("'t' tbl", "'r' || id pk", "'a' cid", "'1' val", "'A' site_id", "1L col_version", "1L cl", "0 seq", "id db_version")
        log.commit(start)
        before = size(tmp_path / str(n))
        log.commit(start.limit(300))
        log.fold()
        wrote.append(size(tmp_path / str(n)) - before)
    assert wrote[1] < 1.2 * wrote[0] < 0.2 * before


def test_what_breaks_off_changes_nothing(spark, tmp_path):
    log = StateLog(spark, str(tmp_path))
    log.commit(spark.createDataFrame(changes(random.Random(2), 30, 9), CHANGELOG), 0, "s")
    before = shown(log.read())
    (tmp_path / "run-0").mkdir()
    broken = tmp_path / "pointer-000000000009-0"
    broken.mkdir()
    (broken / "part-0.txt").write_text('{"number": 9, "runs": [], "ledger": {}}')
    assert shown(log.read()) == before and log.committed("s") == 0


@pytest.fixture
def fed(spark, tmp_path):
    rows = changes(random.Random(3), 60, 12)
    for n in range(3):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], CHANGELOG).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))

    def run(log):
        stream = spark.readStream.schema(CHANGELOG).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.apply_stream(stream, log, str(tmp_path / "told"), str(tmp_path / "at"), DELETE_WINS, raw=str(tmp_path / "raw"))
        return sorted(map(str, live.told(log, str(tmp_path / "told")).drop("stream").collect()))

    return rows, run, tmp_path


def test_streamed_state_and_what_came(spark, fed):
    rows, run, path = fed
    log = StateLog(spark, str(path / "store"), ratio=2, least=8)
    assert live.told(log, str(path / "told")) is None
    assert len(run(log)) >= 12
    whole = spark.createDataFrame(rows, CHANGELOG)
    assert shown(live.told(log, str(path / "raw"))) == shown(whole)
    assert shown(log.read()) == shown(merged(whole))


def test_a_batch_that_is_handed_on_again_keeps_what_it_told(spark, fed):
    rows, run, path = fed
    log = StateLog(spark, str(path / "store"))
    before, runs = run(log), log.runs()
    # the last batch is in the state, but the stream doesn't know that it is done
    (path / "at" / "commits" / "2").unlink()
    (path / "at" / "commits" / ".2.crc").unlink(missing_ok=True)
    assert run(log) == before and log.runs() == runs
    assert shown(log.read()) == shown(merged(spark.createDataFrame(rows, CHANGELOG)))


def test_a_batch_that_broke_off_before_its_commit_is_told_once(spark, fed, monkeypatch):
    rows, run, path = fed
    log = StateLog(spark, str(path / "store"))
    plain, calls = StateLog.commit, []

    def breaks(self, delta, batch=None, stream=""):
        calls.append(batch)
        if calls == [0, 1]:
            raise OSError("lost")
        return plain(self, delta, batch, stream)

    monkeypatch.setattr(StateLog, "commit", breaks)
    with pytest.raises(Exception, match="lost"):
        run(log)
    assert {r["batch"] for r in live.told(log, str(path / "told")).select("batch").collect()} == {0}
    again = run(log)
    assert calls == [0, 1, 1, 2]
    other = StateLog(spark, str(path / "other"))
    monkeypatch.setattr(StateLog, "commit", plain)
    (path / "at").rename(path / "at-before")
    (path / "told").rename(path / "told-before")
    assert run(other) == again


def test_a_large_run_has_a_bounded_number_of_buckets(spark, tmp_path):
    log = StateLog(spark, str(tmp_path), least=16, bucket_rows=4, most_buckets=8)
    cells = spark.range(3000).selectExpr("'t' tbl", "'r' || id pk", "'a' cid", "'1' val", "'A' site_id", "1L col_version", "1L cl", "0 seq", "id db_version")
    log.commit(cells)
    assert [r["buckets"] for r in log.runs()] == [8] and len(list(tmp_path.glob("run-*/__bucket=*"))) == 8
    log.commit(cells.limit(5))
    keys = cells.filter("db_version % 500 = 7").select("tbl", "pk")
    assert log.read().count() == 3000 and log.read(keys).count() == 6
    with pytest.raises(ValueError, match="power of two"):
        StateLog(spark, "x", most_buckets=3)
