"""Token counts, media, packing and language ID."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colmerge.llm import langid, media, packing, textvec, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows_of(df, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=str)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("head", [300_000, 0, 20])
def test_token_counts(spark, awkward, documents, head):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = awkward.select("doc_id", "text").unionByName(documents.limit(60).select("doc_id", "text"))
    got = rows_of(token_counts.token_counts(docs, MODEL, head_rows=head), "n_bytes", "n_tokens")
    assert got == sorted(((i, len(t.encode()), len(processor.encode(t))) for i, t in texts_of(docs)), key=str)
    dealt = docs.withColumn("r", F.rand()).repartition(5, "r").drop("r")  # other rows meet in each evaluation
    assert rows_of(token_counts.token_counts(dealt, MODEL, head_rows=head), "n_bytes", "n_tokens") == got
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_pre_tokens_hold_all_merges():
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert not [p for p in map(processor.id_to_piece, range(processor.get_piece_size())) if "▁" in p.lstrip("▁")]
    count, rng = token_counts.piece_counts(MODEL), random.Random(3)
    for _ in range(3000):
        x = "".join(rng.choice("ab  ▁ \n.,<é漢😀\t") for _ in range(rng.randint(0, 12)))
        assert sum(count(token_counts.pre_tokens(x))) == len(processor.encode(x)), repr(x)


@pytest.mark.parametrize("lacing", list(media.LACINGS))
def test_matroska_round_trip(lacing):
    rng = random.Random(5)
    for n in (1, 2, 8, 9, 64, 65, 200):
        size = [576] * n if lacing == "fixed" else [rng.choice([0, 1, 254, 255, 256, 600, 70_000]) for _ in range(n)]
        frames = [rng.randbytes(k) for k in size]
        data = media.write_matroska(frames, lacing)
        stream = media.read_matroska(data)
        assert [data[p.start : p.start + p.size] for p in stream.packets] == frames
        assert [(p.timestamp, p.duration) for p in stream.packets] == [(k * 72_000_000, 72_000_000) for k in range(n)]
        assert len(stream.clusters) == len(stream.cues) == -(-n // 64)
        assert all(data[c.cluster_start : c.cluster_start + 4] == bytes.fromhex("1f43b675") and data[c.block_start] == 0xA3 for c in stream.cues)
        assert [stream.blocks[c.block_start] for c in stream.cues] == [(c.timestamp, 1) for c in stream.cues] == [(k * 64 * 72_000_000, 1) for k in range(len(stream.cues))]
        assert stream.tracks == {1: media.Track("A_PCM/INT/LIT", 72_000_000, 8000.0, 1, 8)}


def test_matroska_unknown_sizes_groups_and_damage():
    block = media.element(media.BLOCK, b"\x81\x00\x05\x00" + b"abc")
    cluster = media._id(media.CLUSTER) + b"\xff" + media.number(media.TIMESTAMP, 100) + media.element(media.BLOCK_GROUP, block)
    data = media._id(media.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster
    assert [(p.timestamp, p.cluster, data[p.start : p.start + p.size]) for p in media.read_matroska(data).packets] == [(105_000_000, 0, b"abc"), (105_000_000, 1, b"abc")]
    for lacing in media.LACINGS:
        whole = media.write_matroska([b"x" * 576] * 9, lacing)
        for cut in range(1, len(whole)):
            if cut != 40:  # a file that ends behind its head has no segment, and is whole
                with pytest.raises(ValueError):
                    media.read_matroska(whole[:cut])


def test_matroska_scales_durations_references_and_cues():
    e, n = media.element, media.number
    audio = e(media.AUDIO, e(media.SAMPLING, struct.pack(">d", 1000)) + n(media.CHANNELS, 2) + n(media.BIT_DEPTH, 16))
    tracks = e(media.TRACKS, e(media.TRACK_ENTRY, n(media.TRACK_NUMBER, 1) + e(media.CODEC, b"A_PCM/INT/LIT") + audio) + e(media.TRACK_ENTRY, n(media.TRACK_NUMBER, 2) + e(media.CODEC, b"V_X\0") + n(media.DEFAULT_DURATION, 40)))
    info = e(media.INFO, n(media.TIMESTAMP_SCALE, 100_000))
    samples = e(media.SIMPLE_BLOCK, b"\x81\x00\x05\x84\x01" + b"x" * 16)  # fixed lace of two frames of 8 bytes
    plain = e(media.BLOCK_GROUP, e(media.BLOCK, b"\x82\x00\x06\x00" + b"k"))
    later = e(media.BLOCK_GROUP, e(media.BLOCK, b"\x82\x00\x07\x04\x01" + b"ab") + n(media.BLOCK_DURATION, 6) + e(media.REFERENCE_BLOCK, b"\xff"))
    head = n(media.TIMESTAMP, 100)
    cluster = e(media.CLUSTER, head + samples + plain + later)
    at = len(info) + len(tracks)
    point = e(media.CUE_POINT, n(media.CUE_TIME, 106) + e(media.CUE_POSITIONS, n(media.CUE_RELATIVE, len(head + samples)) + n(media.CUE_CLUSTER, at) + n(media.CUE_TRACK, 2)))
    data = e(media.SEGMENT, info + tracks + cluster + e(media.CUES, point))
    stream = media.read_matroska(data)
    told = [(p.track, p.timestamp, p.duration, p.size, p.keyframe) for p in stream.packets]
    assert told == [(1, 10_500_000, 2_000_000, 8, True), (1, 12_500_000, 2_000_000, 8, True), (2, 10_600_000, 40, 1, True), (2, 10_700_000, 300_000, 1, False), (2, 11_000_000, 300_000, 1, False)]
    (cue,) = stream.cues
    assert (cue.timestamp, cue.track) == stream.blocks[cue.block_start] == (10_600_000, 2) and data[cue.block_start] == 0xA0


@pytest.mark.parametrize("body", [b"", b"\x81", b"\x81\x00\x00", b"\x81\x00\x00\x02", b"\x81\x00\x00\x02\x01\xff", b"\x81\x00\x00\x02\x01\x09a", b"\x81\x00\x00\x04\x01abc", b"\x81\x00\x00\x06\x01", b"\x81\x00\x00\x06\x01\xff\x00", b"\x81\x00\x00\x06\x02\x81\x80ab", b"\x00"])
def test_broken_blocks(body):
    for kind in (media.SIMPLE_BLOCK, media.BLOCK):
        data = media.element(media.SEGMENT, media.element(media.CLUSTER, media.element(kind, body)))
        with pytest.raises(ValueError):
            media.read_matroska(data)
    with pytest.raises(ValueError):  # a child longer than what holds it
        media.read_matroska(media.element(media.SEGMENT, media._id(media.CLUSTER) + b"\x82" + media._id(media.SIMPLE_BLOCK) + b"\x85") + b"123456")


def test_random_bytes_are_refused_or_read():
    rng = random.Random(9)
    whole = media.write_matroska([b"x" * 30, b"y"] * 5, "ebml")
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            assert all(p.size >= 0 and p.start + p.size <= len(data) for p in media.read_matroska(bytes(data)).packets)
        except ValueError:
            pass


def out_of_range():
    """Streams that are well formed but hold numbers beyond what the tables can."""
    e, n = media.element, media.number
    block = e(media.SIMPLE_BLOCK, b"\x81\x00\x05\x80abc")

    def stream(*parts):
        return e(media.SEGMENT, b"".join(parts))

    def audio(rate):
        return e(media.AUDIO, e(media.SAMPLING, struct.pack(">d", rate)) + n(media.BIT_DEPTH, 8))

    def track(*parts):
        return e(media.TRACKS, e(media.TRACK_ENTRY, n(media.TRACK_NUMBER, 1) + e(media.CODEC, b"A_PCM/INT/LIT") + b"".join(parts)))

    cluster = e(media.CLUSTER, n(media.TIMESTAMP, 1) + block)
    yield stream(e(media.CLUSTER, e(media.TIMESTAMP, (1 << 70).to_bytes(9, "big")) + block))
    yield stream(e(media.CLUSTER, n(media.TIMESTAMP, 0) + e(media.SIMPLE_BLOCK, (1 << 40 | 1 << 42).to_bytes(6, "big") + b"\x00\x05\x80abc")))
    yield stream(e(media.INFO, n(media.TIMESTAMP_SCALE, 1 << 62)), e(media.CLUSTER, n(media.TIMESTAMP, 1 << 40) + block))
    yield stream(track(audio(1e-300)), cluster)
    yield stream(track(audio(float("nan"))), cluster)
    yield stream(track(n(media.DEFAULT_DURATION, 1 << 63)), cluster)
    point = e(media.CUE_POSITIONS, n(media.CUE_CLUSTER, 1) + n(media.CUE_TRACK, 1 << 40))
    yield stream(cluster, e(media.CUES, e(media.CUE_POINT, n(media.CUE_TIME, 1) + point)))
    yield stream(cluster, e(media.CUES, e(media.CUE_POINT, e(media.CUE_TIME, (1 << 80).to_bytes(11, "big")) + e(media.CUE_POSITIONS, n(media.CUE_CLUSTER, 1)))))


def test_numbers_out_of_range_are_refused():
    for data in out_of_range():
        with pytest.raises(ValueError):
            media.read_matroska(data)


def test_no_damage_ends_the_job(spark):
    rng, rows = random.Random(10), list(out_of_range())
    streams = [media.write_matroska([b"x" * 30, b"y"] * 5, lacing) for lacing in media.LACINGS]
    for k in range(10_000):
        data = bytearray(streams[k % len(streams)])
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        rows.append(bytes(data))
    table = spark.createDataFrame([(k, 1, bytearray(x)) for k, x in enumerate(rows)], "doc_id long, n_bytes long, media binary").repartition(4)
    got = media.media_features(table).select("doc_id", "error", "payload_bytes").collect()
    assert len(got) == len(rows) and all((r["error"] is None) != (r["payload_bytes"] is None) for r in got)
    assert all(r["error"] for r in got if r["doc_id"] < 8)


def test_media_and_features_by_hand(spark):
    """The stored form element by element, and features counted one sample after the other."""
    text = "é 0" * 1300

    def sized(i, body):
        n = len(body)
        width = 1 if n < 127 else 2 if n < 16383 else 3
        return bytes.fromhex(i) + (n + (1 << 7 * width)).to_bytes(width, "big") + body

    payload = text.encode() + b"\xff" * (-len(text.encode()) % 576)
    frames = [payload[k : k + 576] for k in range(0, len(payload), 576)]
    head = sized("1a45dfa3", bytes.fromhex("428681014 2f78101 42f28104 42f38108 428288 6d6174726f736b61 42878104 42858102".replace(" ", "")))
    info = sized("1549a966", bytes.fromhex("2ad7b1830f4240") + sized("4d80", b"media") + sized("5741", b"media"))
    audio = sized("e1", bytes.fromhex("b58445fa0000 9f8101 62648108".replace(" ", "")))
    track = sized("1654ae6b", sized("ae", bytes.fromhex("d78101 73c58101 838102 9c8101 23e38384044aa200".replace(" ", "")) + sized("86", b"A_PCM/INT/LIT") + audio))
    blocks = b"".join(sized("a3", b"\x81" + (b * 72).to_bytes(2, "big") + b"\x84" + bytes([len(frames[b : b + 8]) - 1]) + b"".join(frames[b : b + 8])) for b in range(0, len(frames), 8))
    cluster = sized("1f43b675", b"\xe7\x81\x00" + blocks)
    at = len(info + track)
    cues = sized("1c53bb6b", sized("bb", b"\xb3\x81\x00" + sized("b7", b"\xf7\x81\x01" + b"\xf1\x81" + bytes([at]) + b"\xf0\x81\x03")))
    stored = head + sized("18538067", info + track + cluster + cues)
    row = media.media_features(media.encode_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row["media_bytes"], row["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    level, crossings = sum(abs(x - 128) for x in payload) // len(payload), sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:], strict=False))
    assert row["feature"] == f"codec:1=A_PCM/INT/LIT;clusters:1;packets:{len(frames)};keys:{len(frames)};cues:1;ms:{72 * len(frames)};level:{level};peak:{max(abs(x - 128) for x in payload)};crossings:{crossings}"
    assert [p["size"] for p in row["packets"]] == [576] * len(frames) and [stored[p["start"] :][:576] for p in row["packets"]] == frames
    assert stored[row["cues"][0]["block_start"]] == 0xA3


def test_broken_and_null_media_do_not_end_the_job(spark):
    whole = media.write_matroska([b"x" * 576])
    df = spark.createDataFrame([(1, 3, bytearray(whole)), (2, 3, bytearray(whole[:90])), (3, None, None), (None, 1, bytearray(b""))], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in media.media_features(df).collect()}
    assert rows[1]["error"] is None and rows[2]["error"] and rows[2]["payload_bytes"] is None and rows[2]["media_bytes"] == 90
    assert rows[3]["media_bytes"] is None and rows[3]["packets"] is None and rows[3]["error"] is None and rows[None]["packets"] == []
    assert [tuple(r)[:2] for r in media.packet_table(df).collect()] == [(1, 0)] and media.cue_table(df).count() == 1


def test_media_table(awkward):
    stored = media.encode_media(awkward)
    got = rows_of(media.media_features(stored), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")

    def told(text):
        raw = text.encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])

    assert got == sorted(((i, *told(t)) for i, t in texts_of(awkward)), key=str)
    packets = media.packet_table(stored)
    assert packets.agg(F.sum("size")).first()[0] == sum(g[2] for g in got)
    assert media.media_features(media.encode_media(awkward.limit(0))).count() == 0


def test_packing(awkward, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    docs = awkward.filter("doc_id is not null and doc_id <> 8").select("doc_id", "text").unionByName(documents.limit(40).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    pieces = {}
    for r in packing.pack(docs, JSON, RANKS).collect():
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 and r["bucket"] == r["length"].bit_length() - 1 == r["sequence_id"] % 32
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids"], r["doc_tokens"], r["sequence_id"]))
    for i, t in texts_of(docs):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        own = sorted(pieces[i])
        assert np.frombuffer(b"".join(bytes(p[2]) for p in own), "<u4").tolist() == ids
        assert [p[0] for p in own] == [sum(q[1] for q in own[:k]) for k in range(len(own))] and {p[3] for p in own} == {len(ids)}
    ids = [p[4] for own in pieces.values() for p in own]
    assert len(ids) == len(set(ids))
    laid = packing.pack(docs, JSON, RANKS).withColumn("part", F.spark_partition_id()).select("part", "bucket").collect()
    lengths = {}
    for r in laid:
        lengths.setdefault(r["part"], []).append(r["bucket"])
    assert all(own == sorted(own) for own in lengths.values())
    dealt = docs.withColumn("r", F.rand()).repartition(3, "r").drop("r")
    wanted = [(i, *p[:4]) for i, own in pieces.items() for p in own]
    numbers = packing.pack(dealt, JSON, RANKS).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in numbers) == sorted((i, a, n, bytes(x), t) for i, a, n, x, t in wanted)
    assert {(r["doc_id"], r["start"], r["sequence_id"]) for r in numbers} == {(i, p[0], p[4]) for i, own in pieces.items() for p in own}
    assert packing.pack(awkward, JSON, RANKS).select("doc_id").distinct().count() == awkward.select("doc_id").distinct().count()
    assert packing.pack(docs.limit(0), JSON, RANKS).count() == 0


def test_parts_encode_like_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, encode, rng = Tokenizer.from_file(JSON), packing.encoder(JSON, RANKS).encode, random.Random(2)
    signs = ["a", "b", "'s", "'", "’", " ", " ", "  ", "\n", "\t", " ", "　", "\x1c", "1", ".", "é", "漢", "😀", "<|endoftext|>", "\r\n"]
    for _ in range(5000):
        x = "".join(rng.choice(signs) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(encode(x), "<u4").tolist() == tokenizer.encode(x, add_special_tokens=False).ids, repr(x)
    assert [packing.piece_lengths(n) for n in (1, 6, 2048, 5000)] == [[1], [4, 2], [2048], [2048, 2048, 512, 256, 128, 8]]


def test_language_held_out(documents):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.learn(documents.filter(~held))
    found = langid.identify(documents.filter(held), model).filter(F.length("text") > 60)
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count() > 0


def test_language_mixtures():
    one, two = ("der hund und die katze " * 30).encode(), ("le chat et les chiens " * 30).encode()
    counts = np.full((langid.BINS, 2), langid.SMOOTHING)
    for k, text in enumerate((one, two)):
        bins, _, _ = langid.trigrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        np.add.at(counts[:, k], bins, 1)
    model = langid.Model(["de", "fr"], np.log(counts / counts.sum(axis=0)).astype(np.float32))
    data = one + two + one[: len(one) // 3] + two[: 2 * len(two) // 3]
    ends = np.cumsum([0, len(one), len(two), len(data) - len(one) - len(two)])
    shares = langid.mixtures(np.frombuffer(data, np.uint8), ends, model)
    assert shares[0].tolist() == [1, 0] and shares[1].tolist() == [0, 1]
    assert abs(shares[2, 0] - 1 / 3) < 0.05


def test_language_mixtures_of_six():
    rng = random.Random(8)
    tongues = [[["".join(rng.choice(signs) for _ in range(rng.randint(3, 8))) for _ in range(40)] for signs in ("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzae", "bfjn")][k] for k in range(8)]
    counts = np.full((langid.BINS, 8), langid.SMOOTHING)
    for k, known in enumerate(tongues):
        text = " ".join(known * 5).encode()
        bins, _, _ = langid.trigrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        np.add.at(counts[:, k], bins, 1)
    model = langid.Model([f"l{k}" for k in range(8)], np.log(counts / counts.sum(axis=0)).astype(np.float32))
    six, two, one = (" ".join(" ".join(rng.choices(tongues[k], k=50)) for k in range(n)).encode() for n in (6, 2, 1))
    shares = langid.mixtures(np.frombuffer(six + two + one, np.uint8), np.cumsum([0, len(six), len(two), len(one)]), model)
    assert (np.abs(shares[0, :6] - 1 / 6) < 0.02).all() and not shares[0, 6:].any()
    assert (np.abs(shares[1, :2] - 1 / 2) < 0.02).all() and not shares[1, 2:].any()
    assert shares[2].tolist() == [1] + [0] * 7


def test_language_awkward(awkward):
    model = langid.learn(awkward)
    found = {r["doc_id"]: r for r in langid.identify(awkward, model).collect()}
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 and not found[k]["lang_mix"] for k in (1, 2, 3, 4))
    assert all(found[k]["lang_pred"] == "en" and 0 < found[k]["score"] <= 1 for k in (5, 10, 12, 15)) and found[9]["id"] == "clash"
    nothing = langid.identify(awkward, langid.learn(awkward.filter("lang = 'none'")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"} and nothing.count() == awkward.count()
    assert langid.identify(awkward.limit(0), model).count() == 0
    clash = awkward.withColumn("letters", F.lit(7)).withColumn("__letters", F.lit(8)).withColumn("LANG_MIX_", F.lit(9))
    assert {(r["letters"], r["__letters"], r["LANG_MIX_"]) for r in langid.identify(clash, model).collect()} == {(7, 8, 9)}


def test_words_and_slices():
    import re

    import pyarrow as pa

    texts = ["", "a b", "c", "\td  e\n", " ", "f" * 50, "g h"]
    column = pa.array(texts, pa.large_string())
    for limit in (1, 5, 1000):
        for at, end, data, offsets in textvec.slices(column, limit):
            w = textvec.Words(data, offsets)
            got = [[bytes(data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first, w.first[1:], strict=False)]
            assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts[at:end]]


def test_no_set_of_languages_is_more_likely_than_the_bound():
    rng = np.random.default_rng(6)
    for n_words in (1, 2, 7, 60):
        likely = rng.random((n_words, 5)) ** 4
        words = np.array([n_words])
        full, total = langid._fit(likely, words, np.full((1, 5), 0.2))
        bound = langid._most_likely(likely, words, full)
        assert bound[0] >= total[0] - 1e-9
        for share in rng.dirichlet([0.3] * 5, 300):
            assert np.log(likely @ share).sum() <= bound[0] + 1e-9


def test_a_better_set_behind_worse_ones_is_found():
    """Seven languages of which single ones and small sets explain a text badly, so that several sets in a row are no better."""
    rng = np.random.default_rng(7)
    texts = ["".join(chr(97 + (7 * k + x) % 26) if x else " " for x in rng.integers(0, 5, 900)) for k in range(7)]
    logs = np.full((langid.BINS, 7), 0.5)
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        np.add.at(logs[:, k], langid.trigrams(data, np.array([0, len(data)]))[0], 1)
    model = langid.Model([f"l{k}" for k in range(7)], np.log(logs / logs.sum(axis=0)).astype(np.float32))
    data = np.frombuffer(" ".join(t[:60] for t in texts).encode(), np.uint8)
    shares = langid.mixtures(data, np.array([0, len(data)]), model)[0]
    assert (shares > 0.05).sum() >= 6
