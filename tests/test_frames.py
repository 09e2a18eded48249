"""Frames: round trips, splits by the index, cut and oversized frames."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colmerge.sources.frames import Frames, frame_lines, read_frames, to_frames, write_frames
from colmerge.sources.tables import CHANGELOG, from_wire, rejected_lines


def test_payloads_come_back_split_by_the_index(spark, tmp_path):
    rng = random.Random(1)
    payloads = [rng.randbytes(rng.choice([0, 1, 200, 3000])) for _ in range(500)]
    table = spark.createDataFrame([(bytearray(p),) for p in payloads], "payload binary").repartition(3)
    write_frames(table, str(tmp_path), split=20_000)
    got = read_frames(spark, str(tmp_path))
    assert sorted(bytes(r["payload"]) for r in got.collect()) == sorted(payloads)
    assert got.rdd.getNumPartitions() > 15 and got.filter("error is not null").count() == 0
    # numbers and places are those in the file, wherever it was cut
    for file in tmp_path.glob("*.frames"):
        data, at, told = file.read_bytes(), 0, []
        while at < len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            told.append((len(told), at, size, data[at + 4 : at + 4 + size]))
            at += 4 + size
        own = got.filter(F.col("file") == str(file)).orderBy("frame").collect()
        assert [(r["frame"], r["at"], r["size"], bytes(r["payload"])) for r in own] == told
    # a file without an index is one part
    for index in tmp_path.glob("*.index"):
        index.unlink()
    again = read_frames(spark, str(tmp_path))
    assert again.rdd.getNumPartitions() == len(list(tmp_path.glob("*.frames"))) and sorted(bytes(r["payload"]) for r in again.collect()) == sorted(payloads)


def frame(payload):
    return len(payload).to_bytes(4, "big") + payload


@pytest.mark.parametrize("end", [b"", b"\x00\x00", frame(b"abcdef")[:7], (1 << 31).to_bytes(4, "big") + b"ab"])
def test_cut_and_oversized_frames_are_told(spark, tmp_path, end):
    (tmp_path / "a.frames").write_bytes(frame(b"one") + frame(b"x" * 50) + frame(b"two") + end)
    (tmp_path / "_b.frames").write_bytes(b"\x00")
    rows = read_frames(spark, str(tmp_path), cap=20).orderBy("frame").collect()
    told = [(b"one", None), (None, "too large"), (b"two", None)] + ([(None, "too large" if len(end) == 6 else "cut")] if end else [])
    assert [(r["payload"] and bytes(r["payload"]), r["error"]) for r in rows] == told


def test_a_write_that_fails_leaves_nothing_visible(spark, tmp_path):
    table = spark.createDataFrame([(bytearray(b"x" * n),) for n in (1, 2, 30)], "payload binary")
    with pytest.raises(Exception, match="longer than a frame"):
        write_frames(table, str(tmp_path / "f"), cap=20)
    (tmp_path / "f").mkdir(exist_ok=True)
    assert read_frames(spark, str(tmp_path / "f")).count() == 0
    spark.dataSource.register(Frames)
    with pytest.raises(Exception, match="only added"):
        table.write.format("frames").mode("overwrite").save(str(tmp_path / "f"))


def test_changes_in_frames(spark, tmp_path):
    rows = [("t", f"r{k}", "c", None if k % 5 == 0 else f'"{k}é\n', "AB"[k % 2], 1, 1, None, 7) for k in range(90)]
    log = spark.createDataFrame(rows, CHANGELOG)
    frames = to_frames(log, most=10)
    assert sorted((r["site_id"], r["part"], r["n"]) for r in frames.collect()) == sorted([(s, p, 10) for s in "AB" for p in range(4)] + [(s, 4, 5) for s in "AB"])
    odd = spark.createDataFrame([(bytearray(b"no json"),), (bytearray(b'[{"tbl": "t"}, 3]'),), (bytearray(b"[]"),)], "payload binary")
    write_frames(frames.select("payload").unionByName(odd), str(tmp_path / "f"))
    lines = frame_lines(read_frames(spark, str(tmp_path / "f")))
    assert sorted(map(str, from_wire(lines).collect())) == sorted(map(str, log.collect()))
    assert sorted((r["reason"], r["value"]) for r in rejected_lines(lines).collect()) == [("no key", '{"tbl":"t"}'), ("no object", "3"), ("no object", "no json")]


def test_a_task_reads_many_splits_of_large_data(spark, tmp_path, monkeypatch):
    from colmerge.sources import frames

    payloads = [bytes([k % 251]) * 1000 for k in range(400)]
    table = spark.createDataFrame([(bytearray(p),) for p in payloads], "payload binary").repartition(2)
    write_frames(table, str(tmp_path), split=1000)
    reader = frames.FrameReader({"path": str(tmp_path)})
    assert len(reader.partitions()) <= 2 * frames.TASKS
    monkeypatch.setattr(frames, "TASKS", 4)
    parts = reader.partitions()
    assert len(parts) < 10 and {p.file for p in parts} == set(map(str, tmp_path.glob("*.frames")))
    rows = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted(r["payload"] for r in rows) == sorted(payloads) and all(r["error"] is None for r in rows)
    assert len({(r["file"], r["frame"]) for r in rows}) == 400


def test_a_writer_gets_a_few_payloads_at_a_time(spark, tmp_path, monkeypatch):
    from colmerge.sources import frames

    told = str(tmp_path / "told")

    class Writer(frames.FrameWriter):
        def write(self, batches):
            def seen():
                for batch in batches:
                    with open(told, "a") as out:
                        out.write(f"{batch.num_rows} {batch.nbytes}\n")
                    yield batch

            return super().write(seen())

    class Told(frames.Frames):
        def writer(self, schema, overwrite):
            return Writer(dict(self.options), overwrite)

    monkeypatch.setattr(frames, "Frames", Told)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    payloads = spark.range(0, 40, 1, 1).select(F.encode(F.repeat(F.lit("x"), 1_000_000), "UTF-8").alias("payload"))
    frames.write_frames(payloads, str(tmp_path / "f"))
    lines = [tuple(map(int, line.split())) for line in (tmp_path / "told").read_text().splitlines()]
    assert sum(n for n, _ in lines) == 40 and max(size for _, size in lines) < 2 * frames.HELD
    assert spark.conf.get(key, None) == before
    monkeypatch.undo()
    got = read_frames(spark, str(tmp_path / "f"))
    assert got.agg(F.count("payload"), F.sum("size"), F.count_distinct("payload")).first() == (40, 40_000_000, 1)


def test_a_payload_that_is_null_stops_the_write(spark, tmp_path):
    table = spark.createDataFrame([(bytearray(b"x"),), (None,)], "payload binary").coalesce(1)
    with pytest.raises(Exception, match="needs a payload"):
        write_frames(table, str(tmp_path))
    assert not list(tmp_path.glob("[!.]*.frames"))


def test_settings_come_back(spark):
    from colmerge.sources.shared import setting

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(key, None) is None
    with pytest.raises(ZeroDivisionError), setting(spark, key, "5"):
        with setting(spark, key, "5"):
            pass
        assert spark.conf.get(key) == "5"
        with setting(spark, key, "6"):
            assert spark.conf.get(key) == "6"
        assert spark.conf.get(key) == "5"
        raise ZeroDivisionError
    assert spark.conf.get(key, None) is None


def test_changes_are_dealt_into_frames_without_a_window_over_them(spark):
    rows = [("t", f"r{k}", "c", str(k), [None, "A", "B"][k % 7 % 3], 1, 1, 0, k // 2) for k in range(300)]
    log = spark.createDataFrame(rows, CHANGELOG).repartition(3)
    frames = to_frames(log, most=10)
    assert "Window" not in frames._jdf.queryExecution().optimizedPlan().toString()
    got = {(f["site_id"], f["part"]): [(x["db_version"], x["pk"]) for x in json.loads(bytes(f["payload"]))] for f in frames.collect()}
    want = {}
    for site in (None, "A", "B"):
        own = sorted((r[8], r[1]) for r in rows if r[4] == site)
        want |= {(site, k // 10): own[k : k + 10] for k in range(0, len(own), 10)}
    assert got == want
