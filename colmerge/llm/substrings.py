"""Exact substring deduplication of documents by fixed-block anchors, over runs of ``n`` words.

1. Index: each document's words are cut into non-overlapping blocks of ``(n + 1) // 2`` words. A run of n words holds at least one whole block of
   its own document. Probe: every rolling window of that length, of every document, looks for its block. A block that is found anywhere but at its
   own place is an anchor. Both sides meet in buckets by hash, as packed arrays; a task first combines what it holds itself.
2. Extend: of a document's runs of n words, those that hold an anchor are compared with each other's, in buckets, by 128-bit BLAKE2b digests of their
   words. Runs that occur twice or more are exact repeats; neighbouring ones join to maximal repeats, and their words go.

By symmetry a repeated run holds an anchor in each document where it lies, so no run is lost, and a false anchor (32 bits and a bucket) only costs a
look: what is removed is decided by the digests of the words alone. Everything is judged on the input texts.

Hot passages: what a task sees twice it settles itself and passes on once, so a bucket gets one entry of a run from each task at most. Runs that hold
part of a hot passage and words of their own are all different; so that they don't all go to the passage's bucket, a run's bucket is chosen by its words
that aren't hot, if it has any. What is hot is told by a sample, which decides nothing but the bucket, the same for equal runs. The number of
buckets follows the bytes of text (``BUCKET_BYTES`` each). Rows of one id and text are one row with a count before anything is exchanged. Rows are
known by 128 bits of id and text, so it doesn't matter in which order a lost part of the input comes again; the same exchange serves all three passes.

Cases: a null text has no words; texts shorter than n words keep all; a repeat may overlap itself within a document; rows that repeat are
documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmerge.llm.common import content_keys, shuffle_partitions
from colmerge.llm.textvec import Words, gram_at, gram_starts, gram_sums, mix, slices, text_column

#: Words that a task gathers at least and at most before it packs them, and words for each bucket between; settled entries to a row.
GATHER, MOST_GATHERED, PER_BUCKET, PER_ROW = 2_000_000, 16_000_000, 32, 1 << 11
#: Bytes of text whose blocks or runs go to one bucket, on average.
BUCKET_BYTES = 32 << 20
#: Rows of a sample at least, and their least share: a block in so many rows that their runs fill a bucket is met ``HITS`` times in it on average. Most
#: blocks that are told hot, and the bit that puts them behind the others.
SAMPLE, HITS, MOST_HOT, HOT = 4000, 20, 1 << 20, np.uint64(1 << 63)
KEY = ["key_a", "key_b"]
BUCKET_SCHEMA = "bucket int, once binary, many binary, runs binary, settled binary"
FOUND_SCHEMA = "key_a long, key_b long, start int, length int"
RUN = np.dtype([("key_a", "<i8"), ("key_b", "<i8"), ("start", "<i4"), ("length", "<i4")])
BLOCK = np.dtype([("key_a", "<i8"), ("key_b", "<i8"), ("start", "<i4"), ("hash", "<u4")])
DIGEST = np.dtype([("high", "<u8"), ("low", "<u8")])


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _binary(parts: list[np.ndarray]) -> pa.Array:
    """A binary array of the parts' bytes."""
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _packed(n_buckets: int, once: tuple, many: tuple, runs: tuple, settled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per bucket that has anything. once, many, runs: (bucket of each entry, entries), ordered by bucket."""
    edges = np.arange(n_buckets + 1)
    cuts = [np.searchsorted(b, edges) for b, _ in (once, many, runs)]
    used = np.flatnonzero(sum(np.diff(c) for c in cuts))
    columns = [_binary([x[c[k] : c[k + 1]] for k in used]) for c, (_, x) in zip(cuts, (once, many, runs), strict=True)]
    none = pa.array([b""] * len(used), pa.binary())
    names = ["bucket", "once", "many", "runs", "settled"]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *columns, none], names)
    for at in range(0, len(settled), PER_ROW):
        part = settled[at : at + PER_ROW]
        spread = int(mix(part["key_a"][:1].astype(np.uint64) + np.uint64(at), 20)[0] % np.uint64(n_buckets))
        empty = pa.array([b""], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([spread], pa.int32()), empty, empty, empty, _binary([part])], names)


def _columns(table: pa.Table, kinds: dict) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in kinds.items()}


def _twice(once: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The values that occur twice or more, sorted; each of ``many`` does."""
    s = np.sort(np.concatenate([once, many, many]))
    again = s[1:][s[1:] == s[:-1]]
    return again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _groups(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal digests together, first of each group in it and one more at the end)."""
    order = np.lexsort((digests["low"], digests["high"]))
    high, low = digests["high"][order], digests["low"][order]
    new = np.flatnonzero((high[1:] != high[:-1]) | (low[1:] != low[:-1])) + 1
    return order, np.concatenate([[0], new, [len(order)]]) if len(order) else np.zeros(1, np.int64)


def _found(runs: np.ndarray) -> pa.Table:
    return pa.table([pa.array(runs[name]) for name in RUN.names], list(RUN.names))


def _runs(keys: np.ndarray, length: np.ndarray | int, starts: np.ndarray) -> np.ndarray:
    """Runs of the rows with the keys (two columns)."""
    runs = np.zeros(len(starts), RUN)
    runs["key_a"], runs["key_b"], runs["start"], runs["length"] = keys[:, 0], keys[:, 1], starts, length
    return runs


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in (0, 1)], axis=1)


def anchors(docs: DataFrame, n: int, n_buckets: int, bits: int = 32) -> DataFrame:
    """(key_a, key_b, start, length): the blocks of (key_a, key_b, ..., text) that occur anywhere else, by ``bits`` of their hashes."""
    size = (n + 1) // 2
    gathered = min(MOST_GATHERED, max(GATHER, PER_BUCKET * n_buckets))
    mask = np.uint64((1 << bits) - 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def pack() -> Iterator[pa.RecordBatch]:
            values, times = np.unique(np.concatenate(grams), return_counts=True)
            hashes, keys, starts = (np.concatenate(x) for x in zip(*blocks, strict=True))
            bucket, low = _buckets(values, n_buckets), (values & mask).astype("<u4")
            seen = times[np.searchsorted(values, hashes)] > 1
            order = np.argsort(hashes[~seen], kind="stable")
            left = np.zeros(len(order), BLOCK)
            left["key_a"], left["key_b"], left["start"] = keys[~seen][order, 0], keys[~seen][order, 1], starts[~seen][order]
            left["hash"] = (hashes[~seen][order] & mask).astype("<u4")
            one = times == 1
            yield from _packed(n_buckets, (bucket[one], low[one]), (bucket[~one], low[~one]), (_buckets(hashes[~seen][order], n_buckets), left), _runs(keys[seen], size, starts[seen]))
            grams.clear()
            blocks.clear()

        held = 0
        for batch in batches:
            keys = _keys(batch)
            for at, end, data, offsets in slices(text_column(batch, "text")):
                words = Words(data, offsets)
                starts, row = gram_starts(words.first, size)
                if len(starts):
                    hashes = gram_at(gram_sums(words.hashes()), starts, size)
                    place = starts - words.first[row]
                    block = place % size == 0
                    grams.append(hashes)
                    blocks.append((hashes[block], keys[at:end][row[block]], place[block]))
                    held += len(starts)
                if held >= gathered:
                    yield from pack()
                    held = 0
        if held:
            yield from pack()

    def meet(table: pa.Table) -> pa.Table:
        c = _columns(table, {"once": "<u4", "many": "<u4", "runs": BLOCK, "settled": RUN})
        hit = c["runs"][_among(c["runs"]["hash"], _twice(c["once"], c["many"]))]
        return _found(np.concatenate([_runs(np.stack([hit["key_a"], hit["key_b"]], axis=1), size, hit["start"]), c["settled"]]))

    return _by_bucket(docs.mapInArrow(gather, BUCKET_SCHEMA), meet)


def _by_bucket(packed: DataFrame, meet: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``meet`` of each bucket's rows. The buckets are dealt out in turn, so that each task has equally many."""
    n = shuffle_partitions(packed.sparkSession)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for at, end in pairwise(cuts):
                if end > at:
                    if bucket[at] != now and held:
                        yield from meet(pa.Table.from_batches(held)).to_batches()
                        held = []
                    now = bucket[at]
                    held.append(batch.slice(at, end - at))
        if held:
            yield from meet(pa.Table.from_batches(held)).to_batches()

    return packed.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket").mapInArrow(met, FOUND_SCHEMA)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values from a place on; the last places see fewer."""
    out, have = values.copy(), 1
    while have < width:
        by = min(have, width - have)
        out[:-by] = np.minimum(out[:-by], out[by:])
        have += by
    return out


def _neighbours(rows: np.ndarray, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """First entry of each run of neighbouring starts of one row that go to one bucket, and one more at the end."""
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(bucket) != 0) | (np.diff(rows) != 0)
    return np.concatenate([np.flatnonzero(new), [len(rows)]])


def run_digests(words: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """Digests of the n words from each start, joined by single spaces."""
    size = words.end - words.start + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(words.start - ends[:-1], size) + np.arange(ends[-1])
    joined = words.data[np.minimum(source, len(words.data) - 1)]
    joined[ends[1:] - 1] = 32
    view, digest = memoryview(joined), hashlib.blake2b
    found = [digest(view[a:b], digest_size=16).digest() for a, b in zip(ends[starts].tolist(), (ends[starts + n] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), DIGEST)


def hot_blocks(docs: DataFrame, n: int, n_rows: int) -> np.ndarray:
    """Sorted hashes of blocks that very many rows of (text) hold, by a sample."""
    size = (n + 1) // 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(text_column(batch, "text")):
                words = Words(data, offsets)
                starts, row = gram_starts(words.first, size)
                if len(starts):
                    hashes = gram_at(gram_sums(words.hashes()), starts, size, 21)
                    once = np.unique(np.stack([hashes, row.astype(np.uint64)], axis=1), axis=0)[:, 0]
                    values, times = np.unique(once, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(times)], ["block", "n"])

    share = max(SAMPLE / max(1, n_rows), HITS * size * DIGEST.itemsize / BUCKET_BYTES)
    counts = docs.sample(min(1.0, share), 3).mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= HITS).orderBy(F.desc("n")).limit(MOST_HOT).select("block").toArrow()
    return np.sort(found["block"].to_numpy().astype(np.uint64))


def repeats(docs: DataFrame, n: int, n_buckets: int, hot: np.ndarray) -> DataFrame:
    """(key_a, key_b, start, length): starts of runs of n words, of (key_a, key_b, ..., text, anchors), that occur anywhere else; length: so many starts."""
    size = (n + 1) // 2
    reach = n - size
    gathered = min(MOST_GATHERED, max(GATHER, PER_BUCKET * n_buckets)) // 2
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        known: list[np.ndarray] = []

        def pack() -> Iterator[pa.RecordBatch]:
            digests, least, rows, starts = (np.concatenate(x) for x in zip(*kept, strict=True))
            keys = np.concatenate(known)
            kept.clear()
            known.clear()
            order, groups = _groups(digests)
            times = np.diff(groups)
            again = np.zeros(len(order), bool)
            again[order] = np.repeat(times, times) > 1
            bucket = _buckets(least, n_buckets)
            ends = _neighbours(rows[again], starts[again], np.zeros(int(again.sum()), np.int64))
            settled = _runs(keys[rows[again][ends[:-1]]], np.diff(ends), starts[again][ends[:-1]])
            digest, rows, starts, lead = digests[~again], rows[~again], starts[~again], bucket[~again]
            ends = _neighbours(rows, starts, lead)
            by = np.argsort(lead[ends[:-1]], kind="stable")
            # entries go with their runs: runs ordered by bucket, entries in the same order
            lengths, at = np.diff(ends)[by], ends[:-1][by]
            entry = np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            many = order[groups[:-1][times > 1]]
            many = many[np.argsort(bucket[many], kind="stable")]
            yield from _packed(n_buckets, (lead[entry], digest[entry]), (bucket[many], digests[many]), (lead[at], _runs(keys[rows[at]], lengths, starts[at])), settled)

        held = rows_held = 0
        for batch in batches:
            keys, marks = _keys(batch), batch.column(batch.schema.get_field_index("anchors"))
            for at, end, data, offsets in slices(text_column(batch, "text")):
                part = marks.slice(at, end - at)
                counts = np.diff(np.asarray(part.offsets)) if part.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in part])
                if not counts.sum():
                    continue
                words = Words(data, offsets)
                total, first = len(words.start), words.first
                row = np.repeat(np.arange(end - at), counts)
                place = first[row] + part.flatten().to_numpy()
                low, high = np.maximum(place - reach, first[row]), np.minimum(place, first[row + 1] - n)
                ok = low <= high
                step = np.zeros(total + 1, np.int64)
                np.add.at(step, low[ok], 1)
                np.add.at(step, high[ok] + 1, -1)
                start = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                if not len(start):
                    continue
                grams = np.full(total, np.uint64(2**64 - 1))
                inside = np.arange(max(0, total - size + 1))
                blocks = gram_at(gram_sums(words.hashes()), inside, size, 21)
                grams[: len(inside)] = np.where(_among(blocks, shared.value), blocks | HOT, blocks & ~HOT)
                least = mix(_sliding_min(grams, reach + 1)[start], 22)
                of = np.searchsorted(first, start, side="right") - 1
                kept.append((run_digests(words, start, n), least, rows_held + of, (start - first[of]).astype(np.int64)))
                known.append(keys[at:end])
                rows_held += end - at
                held += len(start)
                if held >= gathered:
                    yield from pack()
                    held = rows_held = 0
        if held:
            yield from pack()

    def meet(table: pa.Table) -> pa.Table:
        c = _columns(table, {"once": DIGEST, "many": DIGEST, "runs": RUN, "settled": RUN})
        both = np.concatenate([c["once"], c["many"], c["many"]])
        order, groups = _groups(both)
        times = np.diff(groups)
        hit = np.zeros(len(both), bool)
        hit[order] = np.repeat(times, times) > 1
        hit = hit[: len(c["once"])]
        lengths = c["runs"]["length"].astype(np.int64)
        run = np.repeat(np.arange(len(lengths)), lengths)[hit]
        starts = (np.repeat(c["runs"]["start"] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum()))[hit]
        ends = _neighbours(run, starts, np.zeros(len(run), np.int64))
        of = c["runs"][run[ends[:-1]]]
        return _found(np.concatenate([_runs(np.stack([of["key_a"], of["key_b"]], axis=1), np.diff(ends), starts[ends[:-1]]), c["settled"]]))

    return _by_bucket(docs.mapInArrow(gather, BUCKET_SCHEMA), meet)


def remove_repeats(docs: DataFrame, n: int = 50, id_column: str = "doc_id", text: str = "text", anchor_bits: int = 32) -> DataFrame:
    """A row per input row: the id, ``n_words``, ``n_removed``, and ``kept_text``, the words that stay, joined by single spaces."""
    body = F.col(text).cast("string")
    n_rows, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()
    n_buckets = max(4 * shuffle_partitions(docs.sparkSession), n_bytes // BUCKET_BYTES)
    hot = hot_blocks(docs.select(body.alias("text")), n, n_rows)
    rows = docs.select(*content_keys(id_column, text), F.col(id_column).alias("id"), body.alias("text"))
    keyed = rows.groupBy(*KEY).agg(F.first("id").alias("id"), F.count("*").alias("times"), F.first("text").alias("text"))
    # all passes read all columns of the rows, so that they share one exchange
    marks = anchors(keyed, n, n_buckets, anchor_bits).groupBy(*KEY).agg(F.collect_list("start").alias("anchors"))
    marked = keyed.join(marks, KEY, "left").select(*KEY, "id", "times", "text", "anchors")
    runs = repeats(marked, n, n_buckets, hot).groupBy(*KEY).agg(F.collect_list(F.struct("start", "length")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for value, times, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = (value or "").encode().split()
                counts.append(len(words))
                if times > 1 and len(words) >= n:  # every run occurs in a row like this one
                    words = []
                elif found.is_valid:
                    runs = found.values
                    start, length = runs.field(0).to_numpy(), runs.field(1).to_numpy()
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + length - 1 + n, -1)
                    stay = np.cumsum(step[:-1]) == 0
                    words = list(compress(words, stay.tolist()))
                removed.append(counts[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["id", "times", "n_words", "n_removed", "kept_text"])

    whole = keyed.join(runs, KEY, "left").select("id", "text", "times", "runs")
    told = whole.mapInArrow(cut, f"id {dict(rows.dtypes)['id']}, times long, n_words long, n_removed long, kept_text string")
    each = told.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(F.col("id").alias(id_column), "n_words", "n_removed", "kept_text")
