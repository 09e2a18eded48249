"""Length-prefixed frames as a Spark source and sink: four bytes of length, highest first, and so many bytes of payload.

The sink writes, beside each file, an index of where frames begin, one entry for each ``split`` bytes or so; the source cuts a file there, so a large file is
read by many tasks. A task reads what lies between neighbouring entries up to ``TASK`` bytes, or up to a share of ``TASKS`` of all bytes if that is less, so
there aren't as many tasks as entries. A file without an index is one task, which reads it as a stream. A frame that is longer than the cap, or that the file's end cuts,
is a row with ``error`` and without ``payload``; a longer one is stepped over. Files become visible when the whole write has succeeded. Paths
are whatever Arrow's file systems open (local, HDFS, object stores).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from colmerge.operators.ordering import counted
from colmerge.sources.shared import setting
from colmerge.sources.tables import CHANGELOG

#: The longest payload, the bytes between two entries of an index, and payload that a batch holds.
CAP, SPLIT, HELD = 64 << 20, 16 << 20, 4 << 20
#: The bytes that a task reads (or a split, if that is longer), and how many tasks there are before they read so much.
TASK, TASKS = 64 << 20, 128
SCHEMA = "file string, frame long, at long, size long, payload binary, error string"


def _visible(file: str) -> bool:
    name = file.rsplit("/", 1)[-1]
    return name.endswith(".frames") and name[0] not in "._"


@dataclass
class Part(InputPartition):
    """Frames of a file that begin from ``start`` on and before ``end``."""

    file: str
    frame: int
    start: int
    end: int


@dataclass
class Wrote(WriterCommitMessage):
    file: str


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.cap = options["path"], int(options.get("cap", CAP))

    def partitions(self) -> list[Part]:
        system, path = fs.FileSystem.from_uri(self.path)
        found = {f.path: f.size for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file}
        data = {file: size for file, size in found.items() if _visible(file)}
        least, parts = min(TASK, sum(data.values()) // TASKS), []
        for file, size in sorted(data.items()):
            cuts = [(0, 0)]
            if f"{file}.index" in found:
                with system.open_input_stream(f"{file}.index") as index:
                    entries = index.read()
                for frame, at in struct.iter_unpack(">QQ", entries[: len(entries) // 16 * 16]):
                    if at - cuts[-1][1] >= least:
                        cuts.append((frame, at))
            ends = [at for _, at in cuts[1:]] + [size]
            parts += [Part(file, frame, at, end) for (frame, at), end in zip(cuts, ends, strict=True)]
        return parts

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        rows, held, at, number = [], 0, partition.start, partition.frame

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        with system.open_input_file(partition.file) as data:
            whole = data.size()
            while at < partition.end:
                data.seek(at)
                head = data.read(4)
                size = int.from_bytes(head, "big") if len(head) == 4 else None
                after = whole if size is None else at + 4 + size
                error = "cut" if size is None or after > whole else "too large" if size > self.cap else None
                if error == "cut" and size is not None and size > self.cap:
                    error = "too large"
                payload = data.read(size) if error is None else None
                rows.append((partition.file, number, at, size, payload, error))
                held, at, number = held + (size if payload else 0), after, number + 1
                if held > HELD or len(rows) >= 4096:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.cap, self.split = options["path"], int(options.get("cap", CAP)), int(options.get("split", SPLIT))
        if overwrite:
            raise ValueError("frames are only added: write to a new folder")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path, recursive=True)
        name, at, cut, index = uuid.uuid4().hex, 0, 0, []
        with system.open_output_stream(f"{path}/.{name}.frames", buffer_size=1 << 20) as out:
            for number, value in enumerate(value for batch in batches for value in batch.column("payload")):
                payload = value.as_buffer()
                if payload is None:
                    raise ValueError("a frame needs a payload")
                if payload.size > self.cap:
                    raise ValueError(f"a payload of {payload.size} bytes is longer than a frame may be")
                if at - cut >= self.split:
                    index.append(number.to_bytes(8, "big") + at.to_bytes(8, "big"))
                    cut = at
                out.write(payload.size.to_bytes(4, "big"))
                out.write(payload)
                at += 4 + payload.size
        with system.open_output_stream(f"{path}/.{name}.frames.index") as out:
            out.write(b"".join(index))
        return Wrote(name)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        for file in (m.file for m in messages if m):
            # the index first: a file is never seen without it
            for end in (".frames.index", ".frames"):
                system.move(f"{path}/.{file}{end}", f"{path}/{file}{end}")

    def abort(self, messages: list[Wrote | None]) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        for file in (m.file for m in messages if m):
            for end in (".frames.index", ".frames"):
                system.delete_file(f"{path}/.{file}{end}")


class Frames(DataSource):
    """``spark.read.format("frames")`` and ``df.write.format("frames")``; options path, cap and (when writing) split."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(dict(self.options), overwrite)


def read_frames(spark: SparkSession, path: str, cap: int = CAP) -> DataFrame:
    """(file, frame, at, size, payload, error): a row for each frame of the files under a folder."""
    spark.dataSource.register(Frames)
    return spark.read.format("frames").option("cap", cap).load(path)


def write_frames(payloads: DataFrame, path: str, cap: int = CAP, split: int = SPLIT) -> None:
    """Adds a frame for each row's ``payload`` (binary). A task holds ``HELD`` bytes of them at a time, or one payload."""
    spark = payloads.sparkSession
    spark.dataSource.register(Frames)
    # what a task hands to its writer lies in memory several times over
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(HELD)):
        payloads.select("payload").write.format("frames").mode("append").option("cap", cap).option("split", split).save(path)


def to_frames(changes: DataFrame, most: int = 1000) -> DataFrame:
    """(site_id, part, n, payload): the changes of each site in order, as JSON arrays of ``most`` of them at most, whatever versions they have."""
    placed = counted(changes.select(*CHANGELOG.names), ["site_id"], ["db_version", "seq", "tbl", "pk", "cid"], "__n")
    line = F.to_json(F.struct(*CHANGELOG.names), {"ignoreNullFields": "false"})
    lines = placed.select("site_id", F.call_function("div", F.col("__n") - 1, F.lit(most).cast("long")).alias("part"), F.struct("__n", line.alias("line")).alias("item"))
    sets = lines.groupBy("site_id", "part").agg(F.array_sort(F.collect_list("item")).alias("items"))
    text = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["line"]), ","), F.lit("]"))
    return sets.select("site_id", "part", F.size("items").cast("long").alias("n"), F.encode(text, "UTF-8").alias("payload"))


def frame_lines(frames: DataFrame) -> DataFrame:
    """(value): the lines of JSON in the payloads, for ``from_wire`` and ``rejected_lines``; a payload that is no array is a line of its own."""
    # an unfolded column isn't computed again by what reads it: each payload is decoded and parsed once
    texts = frames.filter("error is null").select(F.explode(F.array(F.decode("payload", "UTF-8"))).alias("text"))
    parsed = texts.select("text", F.explode(F.array(F.from_json("text", "array<string>"))).alias("lines"))
    whole: Column = F.when(F.startswith(F.ltrim("text"), F.lit("[")) & F.col("lines").isNotNull(), F.col("lines")).otherwise(F.array("text"))
    return parsed.select(F.explode(whole).alias("value"))
