"""The prefix trie of conversations: a minimal-perfect-hash node table with subtree sums.

1. Turns get places 1, 2, ... in their conversation, and each is known by the SHA-256 of its role and text; texts aren't shuffled. A prefix's digest is 128 bits:
   the exclusive or of hashes of its turns with their depths. So digests are running values, a parent's digest follows from a node's own, and a
   conversation with most of the rows is scanned in ranges.
2. Distinct prefixes are counted by (digest, parent's digest, depth, last turn), combined in the tasks before the shuffle. No digest may have two of these:
   then, from the root on, equal digests mean equal prefixes. Should one have, all is done again with other hashes.
3. Sums over subtrees are sums over paths: a node's weight counts for all nodes on the path of its smallest member. Paths are cut into units of ``unit`` depths and dealt
   to shards by hash, so no node and no conversation gathers in one task. What a conversation carries up from deeper units is one more weight at the unit's end.
4. A shard puts a bounded number of whole units into a node table: distinct digests get slots by a minimal perfect hash, each verified against the digest that is
   stored in the slot; weights are scattered into flat arrays and accumulated through the array of parents' slots, deepest first. The shards' partial sums are added up.
5. Ids of conversations that end at a node are joined in ranges of ``IDS``, and hashed in order as a stream (SHA-256 can't be cut into parts).

Cases: null roles and texts are empty; turns are ordered by number, null first, then role, then text, and repeated rows stay turns of their own; rows
without a conversation take no part; texts of any length count whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colmerge.llm.common import written
from colmerge.llm.textvec import mix
from colmerge.operators.ordering import numbered, scanned
from colmerge.sources.shared import matched

#: Depths of a unit, ids in a range of ends, and how often other hashes are tried.
UNIT, IDS, SEEDS = 4096, 4096, 4
NODE, PARENT = ["x", "y"], ["px", "py"]


class NodeTable:
    """Slots 0 to n - 1 of n distinct 128-bit digests: a minimal perfect hash in levels, of which each takes the digests that meet no other there."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = keys, 0
        while len(left):
            place = self._place(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(place, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + taken))
            taken += int(alone.sum())
            left = left[~alone[place]]
        self.keys = np.empty_like(keys)
        self.keys[self._found(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1], 2 * level), 2 * level + 1) % np.uint64(size)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, slot) in enumerate(self.levels):
            place = self._place(keys[left], level, len(alone))
            here = alone[place]
            slots[left[here]] = slot[place[here]]
            left = left[~here]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for one that the table doesn't have."""
        slots = self._found(keys)
        if not len(self.keys):
            return slots
        return np.where((slots >= 0) & (self.keys[slots] == keys).all(axis=1), slots, -1)


def subtree_sums(depth: np.ndarray, own: np.ndarray, parents: np.ndarray, weights: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """(digests, sums) of the nodes of whole units: rows of paths and of weights, with digests (n, 2) and weights (n, k). A unit's first nodes have no parent in it."""
    table = NodeTable(np.unique(own, axis=0))
    slots = table.slots(own)
    up, deep, sums = np.full(len(table.keys), -1), np.zeros(len(table.keys), np.int64), np.zeros((len(table.keys), weights.shape[1]), np.int64)
    deep[slots] = depth
    inner = depth % unit != 0
    up[slots[inner]] = table.slots(parents[inner])
    if (up[slots[inner]] < 0).any():
        raise ValueError("a path without one of its nodes")
    np.add.at(sums, slots, weights)
    order = np.argsort(-deep, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(deep[order])) + 1):
        level = level[up[level] >= 0]
        np.add.at(sums, up[level], sums[level])
    return table.keys, sums


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, place, content, size): turns of each conversation in order, each with the SHA-256 of its role and text and the text's bytes."""
    said, words = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    content = F.unhex(F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, words), 256))
    base = [F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), said.alias("role"), content.alias("content"), F.octet_length(words).cast("long").alias("size")]
    rows = conversations.filter(F.col(conv).isNotNull())
    turns = rows.select(*base)
    # texts decide only where turns of one number and role differ
    key = ["c", "turn", "role"]
    ties = turns.groupBy(*key, "content").count().groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    order = ["turn", "role", "content"]
    if not ties.isEmpty():
        tied = matched(rows.select(*base, words.alias("words")), ties, key, "left_semi").select(*key, "content", "words").distinct()
        turns = matched(turns, numbered(tied, key, "words", "tie").drop("words"), [*key, "content"])
        order = ["turn", "role", "tie", "content"]
    return numbered(turns, ["c"], order, "place").select("c", "place", "content", "size")


def sequences(turns: DataFrame, shared: Column | None = None, base: Column | None = None, most: int = 0) -> DataFrame:
    """(c, depth, content, size, length) of every conversation, the root (depth 0) included.

    With ``shared``, of ``c``, a conversation begins with that many turns, ``most`` at most, of the conversation ``base`` (all of them if it has fewer, none
    if there is none) in the place of its own first ones.
    """
    counts = turns.groupBy("c").agg(F.max("place").alias("n")).withColumn("h", F.lit(0) if shared is None else shared)
    if shared is None:
        known = counts.withColumn("head", F.array().cast("array<struct<content:binary,size:long>>"))
    else:
        heads = turns.filter(F.col("place") <= most).groupBy(F.col("c").alias("b")).agg(F.array_sort(F.collect_list(F.struct("place", "content", "size"))).alias("first"))
        known = counts.withColumn("b", base).join(heads, "b", "left")
        head = F.filter(F.coalesce("first", F.array()), lambda t: t["place"] <= F.col("h"))
        known = known.withColumn("head", F.transform(head, lambda t: F.struct(t["content"].alias("content"), t["size"].alias("size"))))
    known = known.select("c", F.col("h").cast("long").alias("h"), "head", F.size("head").cast("long").alias("k"), "n")
    known = written(known.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    none = F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("size")
    roots = known.select("c", F.lit(0).cast("long").alias("depth"), *none, "length")
    first = known.select("c", F.posexplode("head").alias("at", "t"), "length").select("c", (F.col("at") + 1).cast("long").alias("depth"), "t.content", "t.size", "length")
    own = turns.join(known.drop("head", "n"), "c").filter(F.col("place") > F.col("h")).select("c", (F.col("k") + F.col("place") - F.col("h")).alias("depth"), "content", "size", "length")
    return roots.unionByName(first).unionByName(own)


def paths_of(steps: DataFrame, seed: int) -> DataFrame:
    """Steps of conversations with the digests of the node they lead to and of its parent."""
    none = F.lit(0).cast("long")
    hashes = {"gx": F.xxhash64(F.lit(2 * seed), "depth", "content"), "gy": F.xxhash64(F.lit(2 * seed + 1), "content", "depth")}
    steps = steps.withColumns({k: F.when(F.col("depth") > 0, v).otherwise(none) for k, v in hashes.items()})
    running = scanned(steps, ["c"], ["depth"], {"x": ("bit_xor", F.col("gx")), "y": ("bit_xor", F.col("gy"))})
    return running.withColumns({"px": F.col("x").bitwiseXOR(F.col("gx")), "py": F.col("y").bitwiseXOR(F.col("gy"))}).drop("gx", "gy")


def _counted(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths, and nodes (x, y, px, py, depth, size, n, c: the smallest member, n_children)."""
    for seed in range(SEEDS):
        paths = written(paths_of(steps, seed))
        nodes = written(paths.groupBy(*NODE, *PARENT, "depth", "content").agg(F.count("*").alias("n"), F.min("c").alias("c"), F.max("size").alias("size")).drop("content"))
        if nodes.groupBy(*NODE).count().filter("count > 1").isEmpty():
            children = nodes.filter("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children")).withColumnsRenamed(dict(zip(PARENT, NODE, strict=True)))
            return paths, written(nodes.join(children, NODE, "left").fillna(0, ["n_children"]))
    raise ValueError("prefixes have equal digests under all seeds")


def _sums(paths: DataFrame, nodes: DataFrame, depths: int) -> DataFrame:
    """(x, y, n_leaves, saved): leaves of each node's subtree, and what its nodes' sharing saves."""
    zero = F.lit(0).cast("long")
    unit = F.floor(F.col("depth") / depths).alias("unit")
    columns = ["c", unit, "depth", *NODE, *PARENT]
    weights = nodes.select(*columns, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved"))
    totals = weights.groupBy("c", "unit").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # of conversations of several units, a row a unit
    ends = paths.filter((F.col("length") >= depths) & ((F.col("depth") == F.col("length")) | (F.col("depth") % depths == depths - 1))).select(*columns).join(totals, ["c", "unit"], "left")
    deeper = Window.partitionBy("c").orderBy(F.desc("unit")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({k: F.sum(k).over(deeper) for k in ("leaves", "saved")}).filter("leaves is not null")
    rows = paths.select(*columns, zero.alias("leaves"), zero.alias("saved")).unionByName(weights).unionByName(carried)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(t: np.ndarray) -> pa.RecordBatch:
            keys, sums = subtree_sums(t[:, 2], t[:, 3:5].view(np.uint64), t[:, 5:7].view(np.uint64), t[:, 7:9], depths)
            some = (sums != 0).any(axis=1)
            columns = [*keys[some].view(np.int64).T, *sums[some].T]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["x", "y", "leaves", "saved"])

        held = np.zeros((0, 9), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([x.to_numpy() for x in batch.columns], axis=1)])
            # all but the last unit, which may go on
            end = int(np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1)).max(initial=-1)) + 1
            if end:
                yield told(np.ascontiguousarray(held[:end]))
                held = held[end:]
        if len(held):
            yield told(np.ascontiguousarray(held))

    dealt = rows.repartition("c", "unit").sortWithinPartitions("c", "unit", "depth")
    parts = dealt.mapInArrow(accumulate, "x long, y long, leaves long, saved long")
    return parts.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _ends(paths: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of the nodes at which conversations end."""
    last = paths.filter(F.col("depth") == F.col("length")).select(*NODE, F.floor(F.col("c") / IDS).alias("range"), "c")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids")  # IDS of them at most
    ranges = last.groupBy(*NODE, "range").agg(joined)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for x, y, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (x, y) == now:
                    digest.update(b",")
                else:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (x, y), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, digest.hexdigest()), strict=True))])

    names = ["x", "y", "ends_sha256"]
    return ranges.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids").mapInArrow(digests, "x long, y long, ends_sha256 string")


def prefix_trie(steps: DataFrame, unit: int = UNIT) -> DataFrame:
    """A row per node of the trie of ``sequences``: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths, nodes = _counted(steps)
    full = nodes.join(_sums(paths, nodes, unit), NODE, "left").join(_ends(paths), NODE, "left")
    above = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("c").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    nothing = hashlib.sha256(b"").hexdigest()
    return full.join(above, [*PARENT, "depth"], "left").select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
