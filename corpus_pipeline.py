"""A corpus pipeline of the operators in colmerge.llm: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

``run`` writes what each stage but the last returns to the shared folder, and the next one reads it from there: stages read their input more than once,
and none is computed twice. What a stage has written goes once the next one's result is there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmerge.llm.common import drop_tables, tables_written, written
from colmerge.llm.langid import UNDETERMINED, identify, learn
from colmerge.llm.mixing import mix_sources
from colmerge.llm.near_duplicates import deduplicated
from colmerge.llm.packing import pack
from colmerge.llm.pii import find_pii, redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; texts without a letter, or without evidence of the learned languages (one or a mixture), go."""
    model = learn(docs)
    found = identify(docs, model, keep=COLUMNS, known="known")
    return found.filter((F.col("lang_pred") != UNDETERMINED) & F.col("known")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: one document of each group stays."""
    return deduplicated(docs, n=5, threshold=0.8).select(COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    clean = redact(find_pii(docs.select(COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their size, as many rows in all as there are."""
    return mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, none across documents, those of one length together."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix),
    ("packing", pack_sequences),
]
#: Language ID, near-duplicates and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    start = tables_written()
    for _, stage in first:
        docs = written(stage(spark, docs, sf_dir))
        # the stage's own tables and its predecessor's result go
        drop_tables(spark, start, tables_written() - 1)
        start = tables_written() - 1
    return last(spark, docs, sf_dir)
