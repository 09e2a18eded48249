"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece model (B), by exact-text deduplication.

1. Documents are shuffled by their full text, equal texts combined in the tasks before; each distinct text is then tokenised and aligned once. A
   group ends where tokens of both end at one byte, and the two tokens that end there are a link. Texts are cut before every single space where neither
   tokenizer has a token across it (as in ``packing`` and ``token_counts``), and the parts that a worker has seen last are remembered with
   their alignment; other texts are tokenised whole. What is remembered is bounded and only saves time.
2. Of two linked tokens the bytes of one end with those of the other. So the pairs that can be linked follow from the vocabularies: each token
   and its suffixes, about half a million pairs at most. They are numbered, and a text's links are packed numbers.
3. Links are counted by task into an array of that size, weighted by how many documents have the text, and summed. The sums have a row a pair
   at most, whatever the corpus, and are broadcast as arrays; per text they give the measures.
4. Documents get the measures of their text by a join on its SHA-256, whose left side Spark may split where a text is very common.

Cases: texts that are null or empty, or whose tokens don't join to a space and the text, have no tokens and zeros everywhere; strings of special
tokens are plain text; repeated rows and ids stay rows of their own and all count; other columns are ignored; an empty table gives an empty
result; texts of any length are aligned whole, a text at a time.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmerge.llm.common import written
from colmerge.llm.textvec import text_column

#: Parts that a worker remembers, the longest of them in characters, and characters of text or of groups that a batch holds.
REMEMBERED, LONGEST, HELD = 250_000, 48, 8 << 20
_ODD = re.compile(r" \s|▁")
_NOTHING = ("", 0, 0, b"")


class Aligner(dict):
    """Alignments of parts of texts: groups, tokens of A, tokens of B, linked pairs as 64-bit bytes; ``align`` gives those of whole texts."""

    def __init__(self, json_file: str, ranks_file: str, model_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = Tokenizer.from_file(json_file)
        self.whole.encode_special_tokens = True
        self.part = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = model.encode
        self.a_bytes = [b""] * self.whole.get_vocab_size()
        for token, i in ranks.items():
            self.a_bytes[i] = token
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_sizes, self.b_sizes = ([len(x) for x in side] for side in (self.a_bytes, self.b_bytes))
        self.pairs = possible_pairs(self.a_bytes, self.b_bytes)

    def __missing__(self, part: str) -> tuple[str, int, int, bytes] | None:
        found = self._aligned(" " + part, self._ids(" " + part), self.pieces(part))
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = found
        return found

    def _ids(self, text: str) -> list[int]:
        return self.part(text) if len(text) < 1000 else self.whole.encode(text, add_special_tokens=False).ids

    def align(self, text: str) -> tuple[str, int, int, bytes]:
        """As of a part, but with the numbers of the linked pairs as 32-bit bytes."""
        groups, a, b, links = self._whole(text)
        return groups, a, b, np.searchsorted(self.pairs, np.frombuffer(links, np.int64)).astype("<u4").tobytes()

    def _whole(self, text: str) -> tuple[str, int, int, bytes]:
        if not text:
            return _NOTHING
        full = " " + text
        if text[-1] != " " and not _ODD.search(full):
            found = [self[part] for part in text.split(" ")]
            if None not in found:
                groups, a, b, links = zip(*found, strict=True)
                return ";".join(groups), sum(a), sum(b), b"".join(links)
        return self._aligned(full, self.whole.encode(full, add_special_tokens=False).ids, self.pieces(text)) or _NOTHING

    def _aligned(self, full: str, a: list[int], b: list[int]) -> tuple[str, int, int, bytes] | None:
        """None if the tokens of either don't join to ``full``."""
        raw = full.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        groups, codes, i, j, at_a, at_b, from_a, from_b = [], [], 0, 0, 0, 0, 0, 0
        for i, token in enumerate(a, 1):
            at_a += self.a_sizes[token]
            while at_b < at_a:
                at_b += self.b_sizes[b[j]]
                j += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                codes.append(token * len(self.b_bytes) + b[j - 1])
                from_a, from_b = i, j
        return ";".join(groups), len(a), len(b), array.array("q", codes).tobytes()


def possible_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """Numbers ``a * len(b_bytes) + b``, sorted, of all pairs of ids of which the bytes of one end with those of the other."""
    found = set()
    for longer, shorter, number in ((a_bytes, b_bytes, lambda a, b: a * len(b_bytes) + b), (b_bytes, a_bytes, lambda b, a: a * len(b_bytes) + b)):
        known: dict[bytes, list[int]] = {}
        for i, x in enumerate(shorter):
            known.setdefault(x, []).append(i)
        for i, x in enumerate(longer):
            found.update(number(i, other) for k in range(len(x)) for other in known.get(x[k:], ()))
    return np.array(sorted(found), np.int64)


_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}


def aligner(*files: str) -> Aligner:
    """The worker's aligner, made once."""
    if files not in _ALIGNERS:
        _ALIGNERS[files] = Aligner(*files)
    return _ALIGNERS[files]


def aligned_texts(docs: DataFrame, json_file: str, ranks_file: str, model_file: str, text: str = "text") -> DataFrame:
    """(key, n_docs, n_a, n_b, groups, links) for each distinct text that isn't null: ``groups`` as ``a1,a2|b1;a3|b2``, ``links`` packed numbers of pairs."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(json_file, ranks_file, model_file)
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, held = [], 0
            for key, n, value in zip(keys, times, text_column(batch, "text").to_pylist(), strict=True):
                groups, a, b, links = one.align(value)
                rows.append((key, n, a, b, groups, links))
                held += len(groups)
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names, kinds = ["key", "n_docs", "n_a", "n_b", "groups", "links"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    texts = docs.select(F.col(text).cast("string").alias("text")).filter("text is not null").groupBy("text").agg(F.count("*").alias("n_docs"))
    return texts.select(F.sha2("text", 256).alias("key"), "n_docs", "text").mapInArrow(align, "key string, n_docs long, n_a long, n_b long, groups string, links binary")


def pair_counts(texts: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of the corpus each possible pair has: sums by task, then by pair, of which ``n_pairs`` reach the driver at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for times, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(sums, np.frombuffer(links, "<u4"), times)
        seen = np.flatnonzero(sums)
        for low in range(0, len(seen), 1 << 16):
            part = seen[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], ["pair", "n"])

    counted = texts.select("n_docs", "links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return out


def align(docs: DataFrame, json_file: str, ranks_file: str, model_file: str, id_column: str = "doc_id", text: str = "text", shown: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """A row per row of ``docs``: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, and ``groups``, of which ``shown`` may make something shorter before it is stored."""
    spark = docs.sparkSession
    texts = written(aligned_texts(docs, json_file, ranks_file, model_file, text).withColumn("groups", shown(F.col("groups"))))
    one = aligner(json_file, ranks_file, model_file)
    counts = pair_counts(texts, len(one.pairs))
    b = one.pairs % len(one.b_bytes)
    highest = np.zeros(len(one.b_bytes), np.int64)
    np.maximum.at(highest, b, counts)
    known = spark.sparkContext.broadcast((counts, counts == highest[b]))  # 9 bytes a possible pair

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = known.value
        for batch in batches:
            links = batch.column(4).to_pylist()
            numbers = np.frombuffer(b"".join(links), "<u4")
            ends = np.cumsum([0] + [len(x) // 4 for x in links])
            sums, tops = (np.concatenate([[0], np.cumsum(x[numbers])]) for x in (n, best.astype(np.int64)))
            told = [np.diff(ends), np.diff(tops[ends]), np.diff(sums[ends])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, told)], names)

    names = ["key", "n_a", "n_b", "groups", "n_links", "n_best", "count_sum"]
    measured = texts.select("key", "n_a", "n_b", "groups", "links").mapInArrow(measure, "key string, n_a long, n_b long, groups string, n_links long, n_best long, count_sum long")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    joined = rows.select("id", F.sha2("text", 256).alias("key")).join(measured, "key", "left")
    # a pair of tokens ends each group, so there are as many groups as links
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in (("n_a", "n_a"), ("n_b", "n_b"), ("n_groups", "n_links"), ("n_links", "n_links"), ("n_best", "n_best"), ("count_sum", "count_sum"))]
    return joined.select(F.col("id").alias(id_column), *numbers, F.coalesce("groups", F.lit("")).alias("groups"))
