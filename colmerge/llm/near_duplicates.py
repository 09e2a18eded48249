"""Near-duplicate documents: HyperMinHash registers, banding, corrected estimates, and exact verification on whole shingle sets.

1. A document's set holds 64-bit hashes of its distinct word shingles (A-Z in lower case). Rows of equal sets form a class, which goes on alone.
2. A shingle's hash picks one of ``k`` buckets; a bucket keeps its smallest value as a register of 16 bits: the number of leading zeros (6 bits)
   and the 10 bits behind the first one. A bucket that no shingle picked takes the least of a hash of its own over all shingles.
3. Registers are banded: classes that agree in all registers of a band are candidates. The number of bands follows from the threshold, so that
   a pair at the threshold is missed with a probability of ``MISS``.
4. First pass: a band's first class is its head. Each class is verified against one head, the one with which it shares most bands. So a group
   of near copies costs one look at each of them, however large it is.
5. Second pass: only bands whose classes the first pass left in two or more components are looked at again, and in them only classes of different
   components meet: a component of many classes is cut into blocks of its own, the small ones share blocks, and two blocks of bounded size form
   a group. Bands with the same classes are looked at once. Two sets at the threshold have one of their rarest shingles in common (``prefix_keys``); sets
   travel only to groups in which another one shares such a shingle with them, and has a size that the threshold allows.
6. Where classes meet, pairs whose sizes allow it and that aren't connected yet are verified on whole sets, in the order of the share of equal registers,
   less those that agree by chance given the sizes of the two sets. Registers order the pairs and rule none out. The components of the
   verified links are the result: pairs within a component need no check of their own, so no link between components is lost (but with the
   bands' probability) and no pairs are listed.

Cases: documents without words (null text too) have an empty set and are linked with nothing; with fewer words than a shingle has, the
whole sequence is the one shingle; repeated rows are copies; a null id is never smallest unless all ids of the component are null; an empty table
gives an empty result; other columns are ignored by ``near_duplicates`` and pass through ``deduplicated``, whatever their names. Rows are read
more than once and recognised by 128 bits of id and text, so it doesn't matter how the input is split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmerge.llm.common import content_keys, unused, written
from colmerge.llm.components import components
from colmerge.llm.textvec import Words, gram_at, gram_starts, gram_sums, lower_ascii, mix, slices, text_column

#: Registers in a band, the chance to miss a pair at the threshold by bands, mantissa bits of a register, counts that tell how rare shingles are.
ROWS, MISS, MANTISSA, RARITIES = 6, 1e-7, 10, 1 << 20
#: Members of a block, and shingles of all its members (16 MB), on average; a single longer set is a block's own.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
#: Members that meet one copy of their head in the first pass, on average.
PART = 64
#: Parts into which a component's classes are dealt where they learn its first document.
SALTS = 16


def bands_for(threshold: float, rows: int = ROWS) -> int:
    """The least number of bands with which a pair at the threshold is missed with a probability of ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the first of each row (one entry more)."""
    words = Words(lower_ascii(data), offsets)
    sums = gram_sums(words.hashes())
    at, row = gram_starts(words.first, n)
    hashes = gram_at(sums, at, n, 100 + n)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        hashes = np.concatenate([hashes, mix(gram_at(sums, words.first[short], count[short]) + count[short].astype(np.uint64), 99)])
        row = np.concatenate([row, short])
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(offsets)))


def _codes(values: np.ndarray) -> np.ndarray:
    """Registers of uniform 64-bit values: leading zeros, then the bits behind the first one; larger for smaller values."""
    fraction, exponent = np.frexp((values >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 63).astype(np.uint16)
    bits = ((fraction * 2 - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | (np.uint16((1 << MANTISSA) - 1) - bits)


def registers(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """A row of ``k`` registers for each set; rows of empty sets mean nothing."""
    n = len(first) - 1
    least = np.full(n * k, np.uint64(2**64 - 1))
    row = np.repeat(np.arange(n), np.diff(first))
    bucket = ((mix(hashes, 3) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, row * k + bucket, mix(hashes, 4))
    least = least.reshape(n, k)
    empty = least == np.uint64(2**64 - 1)
    salts = mix(np.arange(k, dtype=np.uint64), 5)
    for r in np.flatnonzero(empty.any(axis=1) & (np.diff(first) > 0)):
        own, holes = hashes[first[r] : first[r + 1]], np.flatnonzero(empty[r])
        step = max(1, (1 << 20) // len(own))
        for at in range(0, len(holes), step):
            part = holes[at : at + step]
            least[r, part] = mix(own[None, :] ^ salts[part][:, None], 6).min(axis=1)
    return _codes(least)


def band_keys(codes: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit keys of the bands of each row of registers."""
    banded = codes.reshape(len(codes), -1, rows).astype(np.uint64) + np.uint64(1)
    keys = np.zeros(banded.shape[:2], np.uint64)
    for j in range(rows):
        keys = mix(keys ^ banded[:, :, j], 7)
    return mix(keys + np.arange(banded.shape[1], dtype=np.uint64), 8)


@lru_cache(maxsize=4)
def chances(k: int) -> np.ndarray:
    """The probability that two disjoint sets share a register, for sizes of 1, 2, 4, ... shingles each (rows and columns).

    A bucket of a set of ``size`` shingles has about ``size / k`` of them; its minimum lies above x with the probability ``above``.
    """
    zeros = np.arange(52)[:, None]
    edges = (2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))).ravel()
    order = np.argsort(edges)
    edges = np.append(edges[order], 1.0)
    size = 2.0 ** np.arange(28)[:, None]
    full, none = -size / k, np.exp(-size / k)
    above = np.exp(full * edges) - none + none * np.exp(size * np.log1p(-np.minimum(edges, 1 - 1e-16)))
    cells = -np.diff(above, axis=1)
    return cells @ cells.T


def estimate(agree: np.ndarray, k: int, sizes: np.ndarray | float = 1.0, others: np.ndarray | float = 1.0) -> np.ndarray:
    """Jaccard similarity of sets from the number of equal registers of ``k``, less those that agree by chance at these sizes."""
    steps = [np.clip(np.round(np.log2(x)), 0, 27).astype(int) for x in (sizes, others)]
    chance = chances(k)[steps[0], steps[1]]
    return ((agree / k) - chance) / (1 - chance)


def signatures(keyed: DataFrame, n: int, threshold: float) -> DataFrame:
    """(key_a, key_b, id, n_shingles, set_a, set_b, bands) of (key_a, key_b, id, text): 128 bits name the set; an empty set has no bands."""
    k = ROWS * bands_for(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in slices(text_column(batch, "text")):
                hashes, first = shingle_sets(data, offsets, n)
                sizes = np.diff(first)
                sums = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(mix(hashes, 9), out=sums[0, 1:])
                np.cumsum(mix(hashes, 10), out=sums[1, 1:])
                ids = mix(sums[:, first[1:]] - sums[:, first[:-1]] + sizes.astype(np.uint64), 11).astype(np.int64)
                keys = band_keys(registers(hashes, first, k)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, keys.shape[1], 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[sizes > 0].reshape(-1)))
                own = [batch.column(c).slice(at, end - at) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(ids[0]), pa.array(ids[1]), lists], ["key_a", "key_b", "id", "n_shingles", "set_a", "set_b", "bands"])

    schema = f"key_a long, key_b long, id {dict(keyed.dtypes)['id']}, n_shingles long, set_a long, set_b long, bands array<long>"
    return keyed.select("key_a", "key_b", "id", "text").mapInArrow(sign, schema)


def shingle_table(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(row, shingles): the packed set of each of ``members`` (row, key_a, key_b: the keys of one of its texts) from ``docs`` (key_a, key_b, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in slices(text_column(batch, "text")):
                hashes, first = shingle_sets(data, offsets, n)
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - at, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(hashes)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists.cast(pa.binary())], ["row", "shingles"])

    # the members grow with the corpus: never broadcast, at any size
    texts = members.join(docs.hint("merge"), ["key_a", "key_b"]).groupBy("key_a", "key_b", "row").agg(F.first("text").alias("text"))
    return texts.select("row", "text").mapInArrow(sets, "row long, shingles binary")


def _linked(sides: np.ndarray, components: np.ndarray, sets: list[np.ndarray], threshold: float, k: int) -> list[tuple[int, int]]:
    """Verified links that connect components in a group: side 0 meets itself, side 1 meets side 2."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    codes = registers(np.concatenate(sets), first, k)
    sizes = np.diff(first)
    parent = {int(c): int(c) for c in components}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # numbers of the group's distinct shingles, so that those that a set shares with others are counted in one step
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(numbers), bool)
    same = sides[0] == 0
    left = np.arange(len(sets)) if same else np.flatnonzero(sides == 1)
    right = left if same else np.flatnonzero(sides == 2)
    found = []
    for i in left:
        others = right[(right > i) | (not same)]
        others = others[[find(int(c)) != find(int(components[i])) for c in components[others]]] if len(others) else others
        smaller, larger = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[smaller >= threshold * larger - 1e-9]
        if not len(others):
            continue
        # the most alike come first, as their links spare most others; the exact count decides
        likely = estimate((codes[others] == codes[i]).sum(axis=1), k, sizes[i], sizes[others])
        others = others[np.argsort(-likely, kind="stable")]
        mark[numbers[first[i] : first[i + 1]]] = True
        both = np.array([np.count_nonzero(mark[numbers[first[j] : first[j + 1]]]) for j in others])
        mark[numbers[first[i] : first[i + 1]]] = False
        for j in others[both >= threshold * (sizes[i] + sizes[others] - both) - 1e-9]:
            x, y = find(int(components[i])), find(int(components[j]))
            if x != y:
                parent[x] = y
                found.append((int(components[i]), int(components[j])))
    return found


def verified(groups: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between components, as many as connect them, in ``groups`` (group, side, row, component) of bounded size."""
    k = ROWS * bands_for(threshold)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides, names, held = None, [], [], []

        def done() -> pa.RecordBatch:
            links = _linked(np.array(sides), np.array(names), held, threshold, k) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for key, side, name, data in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if key != group:
                    yield done()
                    group, sides, names, held = key, [], [], []
                sides.append(side)
                names.append(name)
                held.append(np.frombuffer(data.as_buffer(), np.uint64).copy())
        yield done()

    whole = groups.join(shingles, "row").select("group", "side", "component", "shingles")
    return whole.repartition("group").sortWithinPartitions("group", "side").mapInArrow(verify, "a long, b long")


def promising(groups: DataFrame, prefixes: DataFrame, threshold: float) -> DataFrame:
    """Those of ``groups`` that have, in their group, a class of another component with a rare shingle in common and a size that the threshold allows.

    ``prefixes`` has (row, n_shingles, keys). A class without such a partner can have no link in its group, so its set needn't come there; what
    comes is a few rare shingles.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, keys = None, [], []

        def done() -> pa.RecordBatch:
            sides, rows, names, sizes = np.array(held, np.int64).reshape(-1, 4).T
            kept = np.zeros(len(held), bool)
            if held:
                first = np.cumsum([0] + [len(x) for x in keys])
                numbers = np.unique(np.concatenate(keys), return_inverse=True)[1]
                mark = np.zeros(len(numbers), bool)
                for i in range(len(held)):
                    other = (names != names[i]) & (np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i]) - 1e-9)
                    if sides[i]:
                        other &= sides != sides[i]
                    if other.any():
                        mark[numbers[first[i] : first[i + 1]]] = True
                        kept[i] = (np.logical_or.reduceat(mark[numbers], first[:-1]) & other).any()
                        mark[numbers[first[i] : first[i + 1]]] = False
            return pa.RecordBatch.from_arrays([pa.array([group] * int(kept.sum()), pa.int64()), *[pa.array(c[kept]).cast(k) for c, k in ((sides, pa.int32()), (rows, pa.int64()), (names, pa.int64()))]], ["group", "side", "row", "component"])

        for batch in batches:
            lists = batch.column(5)
            for k, (key, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if key != group:
                    yield done()
                    group, held, keys = key, [], []
                held.append(row)
                keys.append(lists[k].values.to_numpy())
        yield done()

    whole = groups.join(prefixes, "row").select("group", "side", "row", "component", "n_shingles", "keys")
    return whole.repartition("group").sortWithinPartitions("group").mapInArrow(choose, "group long, side int, row long, component long")


def _blocks(count: Column, shingles: Column, block: int) -> Column:
    """The number of blocks for so many classes and shingles."""
    return F.ceil(F.greatest(count / F.lit(block), shingles / F.lit(BLOCK_SHINGLES))).cast("int")


def head_groups(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups of the first pass from ``met`` (band, row, head): each class with the head with which it shares most bands, parts of bounded size."""
    shared = met.filter("row <> head").groupBy("row", "head").agg(F.count("*").alias("n"))
    chosen = shared.groupBy("row").agg(F.max_by("head", F.struct("n", (-F.col("head")).alias("first"))).alias("head")).join(sizes, "row")
    # written, here and below: then both sides of the join are dealt out, and Spark can split a key that very many rows have
    parts = written(chosen.groupBy("head").agg(_blocks(F.count("*"), F.sum("n_shingles"), PART).alias("parts")))
    members = chosen.join(parts, "head").select(F.xxhash64("head", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).alias("group"), F.lit(2).alias("side"), "row")
    heads = parts.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.xxhash64("head", "part").alias("group"), F.lit(1).alias("side"), F.col("head").alias("row"))
    return members.unionByName(heads).withColumn("component", F.col("row"))


def prefix_keys(shingles: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(row, n_shingles, keys): for each of ``rows`` (row) the hashes of its rarest shingles, so many that two sets at the threshold have one of them in common.

    Of ``size`` shingles such a set shares ``threshold * size`` at least, so one of any other ``size - threshold * size`` + 1 is shared; with one order of all
    shingles, the first shared one is among the first so many of both. Any order is right; rare ones first let few meet. How rare a
    shingle is tells a table of ``RARITIES`` counts over these rows, summed by task and then in all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(RARITIES, np.int64)
        for batch in batches:
            for data in batch.column(0):
                np.add.at(sums, _rarity_bins(np.frombuffer(data.as_buffer(), np.uint64)), 1)
        used = np.flatnonzero(sums)
        for low in range(0, len(used), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(used[low : low + (1 << 16)]), pa.array(sums[used[low : low + (1 << 16)]])], ["bin", "n"])

    own = written(shingles.join(rows, "row", "left_semi").select("row", "shingles"))
    counted = own.select("shingles").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # RARITIES rows at most
    table = np.zeros(RARITIES, np.int64)
    table[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    shared = shingles.sparkSession.sparkContext.broadcast(table)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            sizes, keys = [], []
            for data in batch.column(1):
                hashes = np.frombuffer(data.as_buffer(), np.uint64)
                prefix = len(hashes) - math.ceil(threshold * len(hashes) - 1e-9) + 1
                sizes.append(len(hashes))
                keys.append(hashes[np.lexsort((hashes, rarity[_rarity_bins(hashes)]))[:prefix]].view(np.int64))
            ends = np.cumsum([0] + [len(x) for x in keys])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists], ["row", "n_shingles", "keys"])

    return own.mapInArrow(choose, "row long, n_shingles long, keys array<long>")


def _rarity_bins(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 12) % np.uint64(RARITIES)).astype(np.int64)


def rest_groups(known: DataFrame) -> DataFrame:
    """Groups of the second pass from ``known`` (band, row, component, n_shingles): classes of a band that different components hold."""
    bands = known.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("row") % (1 << 40)).alias("sum"), F.bit_xor(F.xxhash64("row")).alias("xor"))
    bands = written(bands.filter("low <> high").groupBy("n", "sum", "xor").agg(F.min("band").alias("band")).select("band"))
    known = written(known.join(bands, "band"))
    units = known.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    # classes are numbered from 0, so -1 names what the small components share
    units = written(units.withColumn("unit", F.when(_blocks(F.col("n"), F.col("s"), BLOCK) > 1, F.col("component")).otherwise(F.lit(-1).cast("long"))))
    blocks = written(units.groupBy("band", "unit").agg(_blocks(F.sum("n"), F.sum("s"), BLOCK).alias("blocks")))
    low, high = (blocks.select("band", F.col("unit").alias(f"{side}_unit"), F.col("blocks").alias(f"{side}_blocks")) for side in ("low", "high"))
    pairs = low.join(high, "band").filter("low_unit < high_unit or (low_unit = -1 and high_unit = -1)")
    ends = F.array(F.struct(F.col("low_unit").alias("unit"), F.lit(1).alias("end")), F.struct(F.col("high_unit").alias("unit"), F.lit(2).alias("end")))
    met = pairs.select("band", "low_unit", "low_blocks", "high_unit", "high_blocks", F.inline(F.when(F.col("low_unit") == F.col("high_unit"), F.array(F.struct(F.col("low_unit").alias("unit"), F.lit(0).alias("end")))).otherwise(ends)))
    rows = known.join(units.select("band", "component", "unit"), ["band", "component"])
    rows = written(rows).join(written(met), ["band", "unit"])
    mine = F.pmod(F.when(F.col("unit") == -1, F.xxhash64("component")).otherwise(F.xxhash64("row")), F.when(F.col("end") == 2, F.col("high_blocks")).otherwise(F.col("low_blocks"))).cast("int")
    rows = rows.withColumn("mine", mine)
    others = F.sequence(F.lit(0), F.when(F.col("end") == 1, F.col("high_blocks")).otherwise(F.col("low_blocks")) - 1)
    rows = rows.withColumn("other", F.explode(others))
    first = F.when(F.col("end") == 1, F.col("mine")).when(F.col("end") == 2, F.col("other")).otherwise(F.least("mine", "other"))
    last = F.when(F.col("end") == 1, F.col("other")).when(F.col("end") == 2, F.col("mine")).otherwise(F.greatest("mine", "other"))
    side = F.when(F.col("end") > 0, F.col("end")).when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return rows.select(F.xxhash64("band", "low_unit", first, "high_unit", last).alias("group"), side.alias("side"), "row", "component")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b, id, n_shingles, component_id, kept) for each input row.

    ``component_id`` is the smallest id of the component. ``kept`` is true for one (id, text) of each component, with that id; rows that repeat
    both are all marked, as nothing tells them apart.
    """
    keyed = docs.select(*content_keys(id_column, text), F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    signed = written(signatures(keyed, n, threshold))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key_a", "key_b")).alias("first")
    classes = signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("row", F.monotonically_increasing_id()))
    banded = classes.select("row", F.explode("bands").alias("band"))
    heads = written(banded.groupBy("band").agg(F.min("row").alias("head"), F.count("*").alias("n")).filter("n > 1").select("band", "head"))
    met = written(banded.join(heads, "band"))
    sizes = classes.select("row", "n_shingles")
    members = met.select("row").distinct().join(classes.select("row", "first.key_a", "first.key_b"), "row")
    shingles = written(shingle_table(keyed.select("key_a", "key_b", "text"), members, n))
    once = components(verified(head_groups(met, sizes), shingles, threshold)).withColumnsRenamed({"node": "row"})
    known = written(sizes.join(once, "row", "left").withColumn("component", F.coalesce("component", "row")))
    groups = written(rest_groups(met.select("band", "row").join(known, "row")))
    groups = promising(groups, prefix_keys(shingles, groups.select("row").distinct(), threshold), threshold)
    twice = components(verified(groups, shingles, threshold)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = classes.select("set_a", "set_b", "row", "first").join(once, "row", "left").withColumn("component", F.coalesce("component", "row"))
    named = written(named.join(written(twice), "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole"))
    best = named.groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("n")).filter("n > 1")
    best = best.select("component", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = named.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(written(best), ["component", "salt"], "left")
    named = named.select("set_a", "set_b", F.coalesce("best", "first").alias("best"))
    told = signed.drop("bands").join(named, ["set_a", "set_b"], "left")
    alone = F.col("best").isNull()  # an empty set is in no class
    kept = alone | ((F.col("best.key_a") == F.col("key_a")) & (F.col("best.key_b") == F.col("key_b")))
    return told.select("key_a", "key_b", F.col("id").alias(id_column), "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of ``docs`` that are kept, with all their columns; of rows that repeat id and text, one."""
    keys = unused(docs.columns, "key_a", "key_b")
    kept = near_duplicates(docs, n, threshold, id_column, text).filter("kept").select(*[F.col(k).alias(name) for k, name in zip(("key_a", "key_b"), keys, strict=True)])
    rows = docs.select("*", *[k.alias(name) for k, name in zip(content_keys(id_column, text), keys, strict=True)]).join(kept, keys, "left_semi")
    return rows.dropDuplicates(keys).drop(*keys)
