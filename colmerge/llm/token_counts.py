"""Token counts by distinct pre-token.

No piece of the vocabulary has a space after another character, so no merge crosses the border before a run of spaces:
a text's tokens are those of its pre-tokens (a run of spaces and the word behind it) put together. So

1. the distinct pre-tokens of all documents are found, with their frequencies (combined in the tasks before the shuffle);
2. the tokenizer sees each distinct pre-token once, and only the number of its pieces is kept;
3. per-document pre-token frequencies are joined to these numbers and summed. The most frequent ``head_rows`` pre-tokens
   (a fixed number, so a broadcast of proven size) are joined inside the scan; the rest of each document's frequencies
   goes through a shuffled join on the pre-token. Ids of documents are never made.

Rows are known by 128 bits of id and text, so it doesn't matter in which order a lost part of the input comes again; rows that repeat both are summed
together and told apart by their number at the end.

Cases: a null text counts as empty (0 tokens); repeated rows, also of one ``doc_id``, stay separate rows; other columns of
the input are ignored; an empty table gives an empty result; a text without spaces is one pre-token, whatever its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmerge.llm.common import content_keys, written
from colmerge.llm.textvec import text_column

#: Pre-tokens of the broadcast head, and the longest of them in characters: so many entries hold 24 million characters at most.
HEAD_ROWS, HEAD_CHARS = 300_000, 80
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHER = 300_000
KEY = ["key_a", "key_b"]
#: A pre-token: a run of spaces and what follows up to the next space. U+2581 is the tokenizer's own sign for a space.
PRE_TOKEN = regex.compile(r"[ ▁]*[^ ▁]+|[ ▁]+")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text without the space that leads each; the tokenizer's own leading space leads the first."""
    if not text:
        return []
    if "  " not in text and "▁" not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    found = PRE_TOKEN.findall(" " + text.replace("▁", " "))
    return [x[1:] for x in found]


def piece_counts(model: str):
    """A function from pre-tokens (without the leading space) to their numbers of pieces."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)

    def count(items: list[str]) -> list[int]:
        # the lone leading space is a pre-token too: the library drops a text that is empty, so it is 1 piece there
        return [len(ids) if item else 1 for item, ids in zip(items, processor.encode(items, num_threads=1), strict=True)]

    return count


def distinct_pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pre_token, n): every distinct pre-token of the corpus with its number of occurrences."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in text_column(batch, text).to_pylist():
                seen.update(pre_tokens(value))
                if len(seen) >= GATHER:
                    yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "n"])
                    seen.clear()
        if seen:
            yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "n"])

    found = docs.select(text).mapInArrow(gather, "pre_token string, n long")
    return found.groupBy("pre_token").agg(F.sum("n").alias("n"))


def counted_pre_tokens(distinct: DataFrame, model: str) -> DataFrame:
    """(pre_token, n, n_pieces): the tokenizer runs once for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counts(model)
        for batch in batches:
            pieces = counter(batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["pre_token", "n", "n_pieces"])

    return distinct.mapInArrow(count, "pre_token string, n long, n_pieces long")


def token_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text", head_rows: int = HEAD_ROWS) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8), ``n_pre_tokens`` and ``n_tokens`` by the tokenizer file ``model``."""
    spark = docs.sparkSession
    docs = docs.select(*content_keys(id_column, text), F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counts = written(counted_pre_tokens(distinct_pre_tokens(docs), model))
    # the head ends at a step of the logarithm of frequency, so choosing it needs only the number of rows at each step
    step = F.floor(F.log2("n") * 16)
    short = counts.filter(F.length("pre_token") <= HEAD_CHARS).withColumn("step", step)
    left, cut = head_rows, 64 * 16
    for r in sorted(short.groupBy("step").count().collect(), reverse=True):  # 64 * 16 rows at most
        left -= r["count"]
        if left < 0:
            break
        cut = r["step"]
    best = short.filter(F.col("step") >= cut)  # head_rows rows at most
    head = spark.sparkContext.broadcast({r["pre_token"]: r["n_pieces"] for r in best.collect()})

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            sizes, numbers, sums = [], [], []
            items, times, ends = [], [], [0]
            for value in text_column(batch, "text").to_pylist():
                found = pre_tokens(value)
                total = 0
                for x, n in Counter(found).items():
                    if (pieces := known.get(x)) is None:
                        items.append(x)
                        times.append(n)
                    else:
                        total += n * pieces
                sizes.append(len(value.encode()))
                numbers.append(len(found))
                sums.append(total)
                ends.append(len(items))
            entries = pa.StructArray.from_arrays([pa.array(items, pa.string()), pa.array(times, pa.int64())], ["pre_token", "n"])
            left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            made = [pa.array(x, pa.int64()) for x in (sizes, numbers, sums)]
            yield pa.record_batch([*batch.columns[:3], *made, left], ["key_a", "key_b", "id", "n_bytes", "n_pre_tokens", "n_head", "rest"])

    schema = "key_a long, key_b long, id long, n_bytes long, n_pre_tokens long, n_head long, rest array<struct<pre_token:string,n:long>>"
    rows = docs.mapInArrow(per_document, schema)
    # one pass feeds both sides: each row's own part is an entry without a pre-token, spread over the join by a key of its own
    own = F.array(F.struct(F.concat(F.lit("▁"), "key_a").alias("pre_token"), F.lit(0).cast("long").alias("n")))
    parts = rows.select(*KEY, F.when(F.size("rest") > 0, F.col("rest")).otherwise(own).alias("rest"), "id", "n_bytes", "n_pre_tokens", "n_head")
    parts = parts.select(*KEY, "id", "n_bytes", "n_pre_tokens", "n_head", F.posexplode("rest").alias("k", "part"))
    parts = parts.select(*KEY, F.when(F.col("k") == 0, F.struct("id", "n_bytes", "n_pre_tokens", "n_head")).alias("own"), "part.pre_token", "part.n")
    joined = parts.join(counts.select("pre_token", "n_pieces"), "pre_token", "left")
    pieces = F.sum(F.col("n") * F.coalesce("n_pieces", F.lit(0))).alias("n_rest")
    summed = joined.groupBy(*KEY).agg(F.first("own", ignorenulls=True).alias("own"), F.count("own").alias("times"), pieces)
    # the sum is that of ``times`` equal rows
    tokens = (F.col("own.n_head") + F.expr("n_rest div times")).alias("n_tokens")
    each = summed.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(F.col("own.id").alias(id_column), "own.n_bytes", "own.n_pre_tokens", tokens)
