"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, and each piece is a sequence.

A document of n ids (with the closing id) gives ``n // MAX_LENGTH`` pieces of ``MAX_LENGTH`` and one piece for each set bit of the rest, longest
first. A sequence is one piece, so no sequence crosses documents and none is padded. Sequences of equal length form a bucket (``bucket`` is the
exponent): the pieces are dealt out by a hash, so that no bucket lies in one task, and each partition has its sequences of one length one after
the other, in an order hashed from their ids, so batches read from it are of one length and mixed. That exchange of the pieces is the only one. Where a
piece goes, and its number there, depend on what it holds alone, not on the order in which documents come (again).

Ids come from the tokenizer file by way of distinct pre-tokens: a byte-level BPE token begins with a space or holds none (a run of white space
apart), so a text may be cut before every single space, and each distinct part is encoded once per worker. The memory of parts is bounded; it
only saves time. Texts with white space on both sides of a space, or with the end-of-text string, are encoded whole.

Cases: a null text counts as empty and becomes one piece, the closing id; repeated rows stay separate; other columns are ignored; an empty
table gives an empty result; texts of any length are encoded whole, a row at a time.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH, CLOSING_ID = 2048, 1
#: Parts of texts that a worker remembers.
REMEMBERED = 200_000
END_OF_TEXT = "<|endoftext|>"
_ASCII_SPACE = (" \n", "  ", " \t", " \r", " \x0b", " \x0c")
_SPACE = re.compile(r" \s")
SCHEMA = "id long, start long, length long, bucket int, doc_tokens long, ids binary"


class Encoder(dict):
    """Ids, as little-endian 32-bit bytes, of parts of texts; a part that isn't known yet is encoded."""

    def __init__(self, json_file: str, ranks_file: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(json_file)
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.part = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[part] = ids = array.array("I", self.part(" " + part)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        odd = any(x in text for x in _ASCII_SPACE) if text.isascii() else _SPACE.search(text)
        if odd or text[-1] == " " or END_OF_TEXT in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, _, rest = text.partition(" ")
        head = array.array("I", self.part(first)).tobytes() if first else b""
        return head + b"".join(map(self.__getitem__, rest.split(" "))) if _ else head


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(json_file: str, ranks_file: str) -> Encoder:
    """The worker's encoder, made once."""
    if (json_file, ranks_file) not in _ENCODERS:
        _ENCODERS[json_file, ranks_file] = Encoder(json_file, ranks_file)
    return _ENCODERS[json_file, ranks_file]


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two, at most ``longest``, that sum to n; longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(docs: DataFrame, json_file: str, ranks_file: str, id_column: str = "doc_id", text: str = "text", longest: int = MAX_LENGTH) -> DataFrame:
    """A row per piece, laid out by bucket: id, start, length, bucket, doc_tokens, ids (little-endian 32-bit), sequence_id and offset (always 0)."""
    return bucketed(cut_documents(docs, json_file, ranks_file, id_column, text, longest), id_column)


def cut_documents(docs: DataFrame, json_file: str, ranks_file: str, id_column: str = "doc_id", text: str = "text", longest: int = MAX_LENGTH) -> DataFrame:
    """The pieces of ``pack``, before they are laid out and numbered."""
    if longest < 1 or longest & longest - 1:
        raise ValueError("the longest sequence must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_file, ranks_file).encode
        closing = CLOSING_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(value or "") + closing
                total, at = len(ids) // 4, 0
                for n in piece_lengths(total, longest):
                    rows.append((key, at, n, n.bit_length() - 1, total, ids[4 * at : 4 * (at + n)]))
                    at += n
                held += len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, SCHEMA).withColumnRenamed("id", id_column)


NAMES = ["id", "start", "length", "bucket", "doc_tokens", "ids"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def bucketed(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The pieces dealt out by a hash of what they hold, in each partition one bucket after the other, with ``sequence_id`` and ``offset``."""
    order = F.xxhash64(id_column, "start", "doc_tokens", "ids")
    laid = pieces.withColumn("order", order).repartition("order").sortWithinPartitions("bucket", "order", id_column, "start").drop("order")
    # unique, and its bucket can be read from it: 16 buckets at most are in use
    numbered = laid.withColumn("sequence_id", F.monotonically_increasing_id() * 32 + F.col("bucket"))
    return numbered.withColumn("offset", F.lit(0).cast("long"))
