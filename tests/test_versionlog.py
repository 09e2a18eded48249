"""The log by version: what a delta reads, appends, compaction and writes that break off."""

import random

from colmerge.operators.delta import catch_up, changes_since
from colmerge.sources.tables import CHANGELOG
from colmerge.sources.versionlog import VersionLog


def shown(df):
    return sorted(map(str, df.select(*CHANGELOG.names).collect()))


def files(df):
    return len(df.inputFiles())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_delta_reads_only_what_is_newer(spark, tmp_path):
    rng = random.Random(1)
    rows = [("t", f"r{rng.randrange(9)}", "c", str(k), "A", 1, 1, 0, k) for k in range(1, 400)] + [("t", "bulk", f"c{k}", "1", "A", 1, 1, k, 250) for k in range(300)]
    log, whole = VersionLog(spark, str(tmp_path), width=50), spark.createDataFrame(rows, CHANGELOG)
    assert log.since(0).count() == log.since(7).count() == 0
    for low in range(0, 400, 80):
        log.append(whole.filter(f"db_version > {low} and db_version <= {low + 80}"))
    read = []
    for version in (0, 49, 50, 120, 250, 399, 1000):
        assert shown(log.since(version)) == shown(changes_since(whole, version))
        read.append(files(log.since(version)) if version < 399 else 0)
    assert read == sorted(read, reverse=True) and read[4] < read[0] / 2
    told = plan(log.since(120))
    assert "PartitionFilters: [isnotnull(range" in told and ">= 2)" in told and "GreaterThan(db_version,120)" in told
    known = spark.createDataFrame([("a", 130), ("b", 399), ("c", 200)], "peer_id string, db_version long")
    assert sorted(map(str, log.catch_up(known).collect())) == sorted(map(str, catch_up(whole, known).collect()))
    before = len(log.folders())
    assert log.compact(most=1) > 0 and len(log.folders()) < before and log.compact(most=1) == 0
    assert shown(log.since(120)) == shown(changes_since(whole, 120)) and shown(log.since()) == shown(whole)
    log.vacuum()
    log.append(whole.limit(0))
    log.vacuum()
    assert shown(log.since()) == shown(whole) and len(list(tmp_path.glob("pointer-*"))) == 2


def test_changes_without_a_version_and_broken_appends(spark, tmp_path):
    rows = [("t", "r", "c", None, None, None, None, None, None), ("t", "r", "c", "1", "A", 1, 1, 0, 9)]
    log, whole = VersionLog(spark, str(tmp_path), width=5), spark.createDataFrame(rows, CHANGELOG)
    log.append(whole)
    whole.selectExpr("*", "3L range").write.partitionBy("range").parquet(str(tmp_path / "data-x"))
    (tmp_path / "pointer-000000000007-x").mkdir()
    assert shown(log.since()) == shown(whole) and log.since(3).count() == 1 and log.since(9).count() == 0


def test_a_long_history_has_few_folders(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path), width=4, most_folders=8)
    whole = spark.range(1, 3001).selectExpr("'t' tbl", "'r' || id pk", "'c' cid", "'1' val", "'A' site_id", "1L col_version", "1L cl", "0 seq", "id db_version")
    log.append(whole.filter("db_version <= 2900"))
    log.append(whole.filter("db_version > 2900 and db_version < 2930"))
    log.append(whole.filter("db_version >= 2930"))
    assert len(log.folders()) <= 24 and {f["step"] for f in log.folders()} == {1, 4, 128}
    for version in (0, 3, 511, 2895, 2900, 2999):
        assert log.since(version).count() == 3000 - version
    assert log.compact(most=1) > 0 and log.compact(most=1) == 0 and log.since(2895).count() == 105 and log.since().count() == 3000
