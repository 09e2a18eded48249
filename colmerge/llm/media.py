"""Matroska media columns: documents stored as PCM tracks, and packet tables read back from the bytes.

``write_matroska`` lays a payload out as one track of 8-bit mono PCM at 8000 Hz: an EBML header, then a segment of known
size with info, tracks, clusters of laced simple blocks and cues. A frame has 576 samples, which last 72 ms.
``read_matroska`` parses streams of this format: variable-length ids and sizes (unknown sizes too), nested masters, simple blocks
and block groups, all four lacings, and cues. It returns a packet table: track, cluster, timestamp and duration in nanoseconds (by the segment's scale,
the track's default duration, a group's own duration or, for PCM, the number of samples), byte range and key frame of each frame (in a
block group: a block without a reference to another). A cue has its time, track, its cluster's byte and that of the block that it names.

Everything is per row: no shuffle, and a task holds one Arrow batch. Cases: a null text counts as empty and becomes one frame
of padding; equal texts give equal bytes; repeated rows stay; other columns of the input are ignored; an empty table gives
an empty result. ``read_matroska`` raises ``ValueError`` for a stream that is cut off or has a broken size, wherever it is cut inside an element. In
tables such a stream doesn't end the job: its row has the message in ``error`` and nulls for what is read; null media have nulls alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, RATE, FRAME_MS, PAD = 576, 8000, 72, 255
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 8

# Element ids fixed by the Matroska format (RFC 8794, RFC 9559).
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0
CUES, CUE_POINT, CUE_POSITIONS, CUE_TIME, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB7, 0xB3, 0xF7, 0xF1, 0xF0
TIMESTAMP, SIMPLE_BLOCK, BLOCK, TIMESTAMP_SCALE, TRACK_NUMBER, CODEC = 0xE7, 0xA3, 0xA1, 0x2AD7B1, 0xD7, 0x86
DEFAULT_DURATION, BLOCK_DURATION, REFERENCE_BLOCK, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0x9B, 0xFB, 0xB5, 0x9F, 0x6264
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: What ends a segment's child of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}
LACINGS = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}
#: Nanoseconds of a timestamp's unit, unless the segment says otherwise.
MILLISECOND = 1_000_000


class Packet(NamedTuple):
    track: int
    cluster: int
    timestamp: int
    duration: int
    start: int
    size: int
    keyframe: bool


class Cue(NamedTuple):
    timestamp: int
    track: int
    cluster_start: int
    block_start: int | None


@dataclass
class Track:
    """What a track says of itself; durations in nanoseconds."""

    codec: str = ""
    duration: int = 0
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0

    def lasts(self, size: int) -> int:
        """Nanoseconds of a frame of so many bytes; 0 if the track doesn't tell."""
        if self.duration or not (self.codec.startswith("A_PCM") and self.bits):
            return self.duration
        return round(size * 8 / (self.bits * self.channels) * 1e9 / self.rate)


@dataclass
class Stream:
    packets: list[Packet] = field(default_factory=list)
    cues: list[Cue] = field(default_factory=list)
    tracks: dict[int, Track] = field(default_factory=dict)
    clusters: dict[int, int] = field(default_factory=dict)  # first byte: first byte of the body
    blocks: dict[int, tuple[int, int]] = field(default_factory=dict)  # first byte: timestamp, track


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones is kept for the unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(x: int, body: bytes) -> bytes:
    return _id(x) + size_bytes(len(body)) + body


def number(x: int, n: int) -> bytes:
    return element(x, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], lacing: str) -> bytes:
    """The lace header of a block: the number of frames, less one, and all sizes but the last."""
    if lacing == "none":
        return b""
    head = bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if lacing == "fixed":
        return head
    if lacing == "xiph":
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    parts = [size_bytes(n) for n in sizes[:-1][:1]]  # a lace of one frame has no sizes
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        parts.append(size_bytes(b - a + (1 << 7 * width - 1) - 1, width))
    return head + b"".join(parts)


def write_matroska(frames: list[bytes], lacing: str = "fixed") -> bytes:
    """The frames, of 72 ms each, as a Matroska file with one track."""
    header = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, MILLISECOND) + element(0x4D80, b"media") + element(0x5741, b"media"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">f", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, int(lacing != "none")) + number(DEFAULT_DURATION, FRAME_MS * MILLISECOND) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    parts = [info, element(TRACKS, track)]
    at, cues = sum(map(len, parts)), []
    in_block = 1 if lacing == "none" else FRAMES_PER_BLOCK
    for c in range(0, len(frames), FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER):
        chunk = frames[c : c + FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER]
        body = [number(TIMESTAMP, c * FRAME_MS)]
        for b in range(0, len(chunk), in_block):
            laced = chunk[b : b + in_block]
            head = b"\x81" + (b * FRAME_MS).to_bytes(2, "big", signed=True) + bytes([0x80 | LACINGS[lacing] << 1])
            body.append(element(SIMPLE_BLOCK, b"".join([head, _lace(laced, lacing), *laced])))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at) + number(CUE_RELATIVE, len(body[0])))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(parts))


def _variable(data: bytes, at: int, end: int, keep: bool) -> tuple[int, int]:
    """A variable-length number before ``end`` (``keep``: with its marker bit, as ids have it; else -1 if unknown) and where it ends."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    after = at + width
    if after > end:
        raise ValueError(f"what holds the number at byte {at} ends inside it")
    n = int.from_bytes(data[at:after], "big")
    if not keep:
        n -= 1 << 7 * width
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, after


def _frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The sizes of a block's frames, and where the first begins."""
    if lacing == 0:
        return [end - at], at
    if at >= end:
        raise ValueError("a laced block without a number of frames")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("a fixed lace whose size isn't a multiple of its frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == 1:
            n = 0
            while True:
                if at >= end:
                    raise ValueError("a block ends inside its lace")
                n, at = n + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            n, after = _variable(data, at, end, False)
            n, at = (n if k == 0 else sizes[-1] + n - ((1 << 7 * (after - at) - 1) - 1)), after
        if n < 0:
            raise ValueError("a frame of a lace has no size")
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if sizes[-1] < 0:
        raise ValueError("a lace is longer than its block")
    return sizes, at


class _Reader:
    """Walks through the elements of a stream and notes what they tell."""

    def __init__(self, data: bytes):
        self.data, self.found = data, Stream()
        self.segment = self.now = 0
        self.scale, self.track = MILLISECOND, Track()
        self.group_start, self.group_at, self.reference, self.lasts = 0, 0, False, 0
        self.cue_time, self.cue = 0, {}

    def opened(self, kind: int, at: int, body: int) -> None:
        if kind == SEGMENT:
            self.segment = body
        elif kind == CLUSTER:
            self.found.clusters[at] = body
        elif kind == TRACK_ENTRY:
            self.track = Track()
        elif kind == BLOCK_GROUP:
            self.group_start, self.group_at, self.reference, self.lasts = len(self.found.packets), at, False, 0
        elif kind == CUE_POSITIONS:
            self.cue = {}

    def closed(self, kind: int) -> None:
        packets = self.found.packets
        if kind == BLOCK_GROUP:
            own = packets[self.group_start :]
            each = self.lasts // len(own) if own else 0
            for k, p in enumerate(own):
                longer = p._replace(timestamp=own[0].timestamp + k * each, duration=each) if each else p
                packets[self.group_start + k] = longer._replace(keyframe=not self.reference)
        elif kind == CUE_POSITIONS and CUE_CLUSTER in self.cue:
            self.found.cues.append(Cue(self.cue_time, self.cue.get(CUE_TRACK, 0), self.segment + self.cue[CUE_CLUSTER], self.cue.get(CUE_RELATIVE)))

    def block(self, kind: int, at: int, body: int, end: int) -> None:
        data, found = self.data, self.found
        number_, p = _variable(data, body, end, False)
        if p + 3 > end:
            raise ValueError(f"the block at byte {at} ends inside its head")
        flags, time = data[p + 2], (self.now + int.from_bytes(data[p : p + 2], "big", signed=True)) * self.scale
        found.blocks[self.group_at if kind == BLOCK else at] = (time, number_)
        track = found.tracks.get(number_, Track())
        sizes, p = _frame_sizes(data, p + 3, end, flags >> 1 & 3)
        for n in sizes:
            lasts = track.lasts(n)
            found.packets.append(Packet(number_, len(found.clusters) - 1, time, lasts, p, n, bool(flags & 0x80)))
            p, time = p + n, time + lasts

    def value(self, kind: int, body: int, end: int) -> None:
        part = self.data[body:end]
        n = int.from_bytes(part, "big")
        if kind == TIMESTAMP:
            self.now = n
        elif kind == TIMESTAMP_SCALE:
            self.scale = n
        elif kind == TRACK_NUMBER:
            self.found.tracks[n] = self.track
        elif kind == CODEC:
            self.track.codec = part.rstrip(b"\0").decode()
        elif kind == DEFAULT_DURATION:
            self.track.duration = n
        elif kind == SAMPLING:
            if len(part) not in (4, 8):
                raise ValueError("a sampling rate that is no float")
            self.track.rate = float(np.frombuffer(part, f">f{len(part)}")[0]) or RATE
        elif kind == CHANNELS:
            self.track.channels = n or 1
        elif kind == BIT_DEPTH:
            self.track.bits = n
        elif kind == REFERENCE_BLOCK:
            self.reference = True
        elif kind == BLOCK_DURATION:
            self.lasts = n * self.scale
        elif kind == CUE_TIME:
            self.cue_time = n * self.scale
        elif kind in (CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE):
            self.cue[kind] = n


#: Least and largest values of the columns of packets and cues.
_SMALL, _LARGE = (-(1 << 31), (1 << 31) - 1), (-(1 << 63), (1 << 63) - 1)
_RANGES = {Packet: (_SMALL, _SMALL, _LARGE, _LARGE, _LARGE, _LARGE), Cue: (_LARGE, _SMALL, _LARGE, _LARGE)}


def read_matroska(data: bytes) -> Stream:
    """The packet table, cues and tracks of a stream, and where its clusters and blocks lie; ``ValueError`` for a broken one, or one with numbers beyond the tables' columns."""
    try:
        found = _walked(data)
    except OverflowError as e:
        raise ValueError(f"a number out of range: {e}") from None
    for kind, rows in ((Packet, found.packets), (Cue, found.cues)):
        for name, (least, most), column in zip(kind._fields, _RANGES[kind], zip(*rows, strict=True), strict=False):
            known = [x for x in column if x is not None]
            if known and not least <= min(known) <= max(known) <= most:
                raise ValueError(f"a {kind.__name__.lower()}'s {name} is out of range")
    return found


def _walked(data: bytes) -> Stream:
    reader, at = _Reader(data), 0
    around: list[tuple[int, int, bool]] = []  # the masters that are open: id, end, unknown size

    def close() -> None:
        reader.closed(around.pop()[0])

    while at < len(data):
        while around and at >= around[-1][1]:
            close()
        kind, body = _variable(data, at, len(data), True)
        size, body = _variable(data, body, len(data), False)
        if kind in TOP:
            while around and around[-1][2] and (around[-1][0] != SEGMENT or kind in (EBML, SEGMENT)):
                close()
        outer = around[-1][1] if around else len(data)
        end = outer if size < 0 else body + size
        if end > outer or body > outer:
            raise ValueError(f"element {kind:X} at byte {at} ends behind what holds it")
        if kind in MASTERS:
            around.append((kind, end, size < 0))
            reader.opened(kind, at, body)
        elif kind in (SIMPLE_BLOCK, BLOCK):
            reader.block(kind, at, body, end)
        else:
            reader.value(kind, body, end)
        at = body if kind in MASTERS else end
    while around:
        close()
    found = reader.found
    found.cues = [c._replace(block_start=found.clusters[c.cluster_start] + c.block_start if c.block_start is not None and c.cluster_start in found.clusters else None) for c in found.cues]
    return found


def payload_frames(text: str | None) -> tuple[int, list[bytes]]:
    """The UTF-8 length of a text, and its bytes padded with 255 to whole frames, one frame at least."""
    raw = (text or "").encode()
    padded = raw + bytes([PAD]) * (-len(raw) % FRAME or (FRAME if not raw else 0))
    return len(raw), [padded[k : k + FRAME] for k in range(0, len(padded), FRAME)]


def encode_media(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lacing: str = "fixed") -> DataFrame:
    """(id, n_bytes, media): each text stored as a Matroska file in a binary column."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [payload_frames(x) for x in batch.column(1).to_pylist()]
            media = pa.array([write_matroska(frames, lacing) for _, frames in done], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in done], pa.int64()), media], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "id long, n_bytes long, media binary").withColumnRenamed("id", id_column)


def payload_of(data: bytes, packets: list[Packet]) -> bytes:
    """The payload put together from the packets' byte ranges."""
    view = memoryview(data)
    return b"".join([view[p.start : p.start + p.size] for p in packets])


def feature_text(stream: Stream, payload: bytes) -> str:
    """What the packet table, the cues and the samples say of a stream."""
    samples = np.frombuffer(payload, np.uint8)
    loud = np.abs(samples.astype(np.int16) - 128)
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    clusters = len({p.cluster for p in stream.packets})
    exact = sum(stream.blocks.get(c.block_start) == (c.timestamp, c.track) for c in stream.cues)
    lasts = max((p.timestamp + p.duration for p in stream.packets), default=0) // MILLISECOND
    keys = sum(p.keyframe for p in stream.packets)
    codec = ",".join(f"{k}={t.codec}" for k, t in sorted(stream.tracks.items()))
    return f"codec:{codec};clusters:{clusters};packets:{len(stream.packets)};keys:{keys};cues:{exact};ms:{lasts};level:{int(loud.sum()) // max(1, len(loud))};peak:{int(loud.max(initial=0))};crossings:{crossings}"


PACKETS = "array<struct<track:int,cluster:int,timestamp:bigint,duration:bigint,start:bigint,size:bigint,keyframe:boolean>>"
CUE_LIST = "array<struct<timestamp:bigint,track:int,cluster_start:bigint,block_start:bigint>>"
READ = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets", "cues", "error"]
READ_SCHEMA = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets {PACKETS}, cues {CUE_LIST}, error string"


def _structs(rows: list[list[tuple] | None], kinds: dict[str, pa.DataType]) -> pa.Array:
    """Lists of named tuples, or null, as an array of lists of structs."""
    flat = [x for own in rows if own for x in own]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(kinds)
    items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
    ends = np.cumsum([0, *[len(own or ()) for own in rows]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([own is None for own in rows]))


def _read(data: bytes | None) -> tuple:
    """The values of ``READ`` for one stream."""
    if data is None:
        return (None,) * len(READ)
    stored = (len(data), hashlib.sha256(data).hexdigest())
    try:
        stream = read_matroska(data)
    except ValueError as e:
        return (None, None, None, *stored, None, None, None, str(e))
    payload = payload_of(data, stream.packets)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature_text(stream, payload), stream.packets, stream.cues, None)


def media_features(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, and what is read back from each media file: payload digests, features, packets, cues, error), one row per input row."""
    numbers = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()
    packet_kinds = dict(zip(Packet._fields, numbers, strict=True))
    cue_kinds = dict(zip(Cue._fields, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), packet_kinds, cue_kinds, pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(2)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(READ)
            made = [_structs(list(c), k) if isinstance(k, dict) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "n_bytes", *READ])

    rows = media.select(F.col(id_column).cast("long").alias("id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media")
    return rows.mapInArrow(read, f"id long, n_bytes long, {READ_SCHEMA}").withColumnRenamed("id", id_column)


def packet_table(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A row per packet of each media file, numbered: track, cluster, timestamp and duration in ns, byte range, key frame. Null or broken media have none."""
    read = media_features(media, id_column)
    return read.select(id_column, F.posexplode("packets").alias("packet", "p")).select(id_column, "packet", "p.*")


def cue_table(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A row per cue of each media file: timestamp in ns, track, the bytes where its cluster and its block begin."""
    read = media_features(media, id_column)
    return read.select(id_column, F.posexplode("cues").alias("cue", "c")).select(id_column, "cue", "c.*")
