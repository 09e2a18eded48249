"""Folds by event time over a stream against the batch forms, however events are dealt out; views that load what is there."""

import random

from pyspark.sql import functions as F

from colmerge.operators import metrics, peers
from colmerge.streaming import live

START = 1_700_000_000


def streamed(spark, rows, schema, path, fold, slices):
    """Rows of ``fold`` over files of rows; a last file lets the watermark pass all."""
    for k, own in enumerate([*slices, [(rows[0][0], "other", START + 10**8, -1)]]):
        table = spark.createDataFrame(own, schema).withColumn("at", F.timestamp_seconds("at"))
        table.coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    run = fold(stream).writeStream.outputMode("append").format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "c"))
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(fold(stream).schema).parquet(str(path / "out"))


def late_slices(rng, rows, n, delay):
    """Slices by time of arrival: each event comes up to ``delay`` after its time."""
    arrived = sorted(((r[2] + rng.randrange(delay), r) for r in rows), key=lambda x: x[0])
    return [[r for _, r in arrived[k * len(rows) // n : (k + 1) * len(rows) // n]] for k in range(n)]


def test_debounce_by_time_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), "", START + rng.randrange(4000), k) for k in range(300)]
    rows.append(("x", "", rows[-1][2], 300))
    table = spark.createDataFrame(rows, "topic string, event_type string, at long, position long")
    told = sorted(map(tuple, peers.debounce(table.select("topic", "at", "position"), 60).collect()))
    got = streamed(spark, rows, "topic string, event_type string, at long, position long", tmp_path, lambda s: live.debounced_by_time(s, 60_000, "100 seconds"), late_slices(rng, rows, 4, 90))
    got = sorted((r["topic"], r["fired_at"] // 1000, r["edge"], r["position"]) for r in got.filter("position >= 0").collect())
    assert got == told and len(got) > 60


def test_outcomes_by_time_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(run, rng.choice(["peer_synced", "peer_connected", "other", "other", None]), START + 50 * run + rng.randrange(40), 100 * run + k) for run in range(25) for k in range(rng.randrange(1, 8))]
    table = spark.createDataFrame(rows, "run_id long, event_type string, at long, position long")
    told = sorted(map(tuple, metrics.sync_outcome(table.select("run_id", F.coalesce("event_type", F.lit("")).alias("event_type"), "at"), grace=5, timeout=20).collect()))
    got = streamed(spark, rows, "run_id long, event_type string, at long, position long", tmp_path, lambda s: live.outcomes_by_time(s, 5000, 20_000, "60 seconds"), late_slices(rng, rows, 3, 50))
    assert sorted(map(tuple, got.collect())) == told and len({r[1] for r in told}) == 3


def test_a_view_loads_the_state_that_is_there(spark, tmp_path):
    schema = "tbl string, pk string, cid string, val string, position long"
    start = spark.createDataFrame([("t", "r", "a", "1", 1), ("t", "r", "b", "2", 2), ("t", "s", "a", "9", 3), ("t", "q", "a", "old", 4)], schema)
    spark.createDataFrame([("t", "r", "b", "3", 5), ("t", "s", "__deleted", None, 6), ("t", "n", "a", "new", 7), ("t", "r", "a", "late", 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = live.reactive_view(stream, start).writeStream.outputMode("update").format("memory").queryName("loaded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("loaded").collect())) == [("t", "n", "a", "new", 7), ("t", "r", "a", "1", 1), ("t", "r", "b", "3", 5), ("t", "s", "__deleted", None, 6)]
