"""The queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.token_counts import token_counts

    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.media import encode_media, media_features

    return media_features(encode_media(documents(spark, sf_dir)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.pii import BASE_KINDS, find_pii, span_text

    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(BASE_KINDS))
    kinds = F.transform("pii", lambda s: s["kind"])
    counts = [(F.size("pii") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    score = F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score")
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("pii")).alias("spans"), score)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.langid import identify, learn

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = learn(docs.filter("not held_out"))
    return identify(docs, model, keep=["doc_id", "held_out"])


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.near_duplicates import near_duplicates

    found = near_duplicates(documents(spark, sf_dir), n=3, threshold=0.85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.sharding import shard_rows

    shards = shard_rows(documents(spark, sf_dir))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.packing import pack

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.substrings import remove_repeats

    found = remove_repeats(documents(spark, sf_dir), n=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.neighbours import nearest_neighbours

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.prefix_trie import ordered_turns, prefix_trie, sequences

    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    shared = F.crc32(F.col("c").cast("string").cast("binary")) % 9
    return prefix_trie(sequences(turns, shared, F.col("c") - F.col("c") % 5, most=8))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.alignment import align

    def digest(groups: Column) -> Column:
        return F.when(groups == "", "").otherwise(F.sha2(groups, 256))

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    return align(documents(spark, sf_dir), *files, shown=digest).withColumnRenamed("groups", "groups_sha256")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colmerge.llm.exact_search import top_k

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


#: SQL of op11: CRC-32 bit by bit; a prefix's key is its turns' digests in order; a node's weights go to all nodes on the path of its smallest member.
OP11_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
         md5(concat(len(coalesce(role, '')), ':', role, text)) AS said, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, c - c % 5 AS b, max(p) AS n, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h
  FROM t GROUP BY c),
convs AS (SELECT o.*, least(h, coalesce((SELECT m.n FROM own m WHERE m.c = o.b), 0)) AS k FROM own o),
steps AS (
  SELECT o.c, t.p AS depth, t.said, t.size FROM convs o JOIN t ON t.c = o.b AND t.p <= o.h
  UNION ALL SELECT o.c, o.k + t.p - o.h, t.said, t.size FROM convs o JOIN t ON t.c = o.c AND t.p > o.h),
paths AS (
  SELECT c, depth, string_agg(said, ',') OVER (PARTITION BY c ORDER BY depth) AS key, size,
         string_agg(said, ',') OVER (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up
  FROM steps UNION ALL SELECT c, 0, '', 0, NULL FROM own),
nodes AS (SELECT key, any_value(coalesce(up, '')) AS up, max(depth) AS depth, max(size) AS size, count(*) AS n, min(c) AS c FROM paths GROUP BY key),
children AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
sums AS (
  SELECT a.key, sum((n.n - 1) * n.size)::BIGINT AS saved, count_if(m.key IS NULL) AS leaves
  FROM nodes n LEFT JOIN children m ON m.key = n.key JOIN paths a ON a.c = n.c AND a.depth <= n.depth GROUP BY a.key),
ends AS (
  SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha
  FROM paths JOIN (SELECT c AS last, max(depth) AS most FROM paths GROUP BY c) ON c = last AND depth = most GROUP BY key)
SELECT n.c AS conv_id, n.depth::BIGINT AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(m.n_children, 0) AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON n.depth > 0 AND u.key = n.up LEFT JOIN children m ON m.key = n.key JOIN sums s ON s.key = n.key LEFT JOIN ends e ON e.key = n.key
"""

#: SQL of op13: every query against every row.
OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: SQL of op7: the same rates, hashes and inversion. A sum runs in the same order as the operator's.
OP7_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(n) * sum(n) OVER () / (sum(sqrt(n)) OVER () * n) AS rate FROM counts),
drawn AS (
  SELECT d.*, r.rate, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), '7')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
cdf AS (
  SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, range(0, 800) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
numbers AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.u, count(c.k)::BIGINT AS copies
  FROM drawn d LEFT JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND d.u >= c.c GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copies, t.copy::BIGINT AS copy,
       md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), t.copy, '7:order')) AS shuffle_key
FROM numbers, LATERAL (SELECT unnest(range(0, copies)) AS copy) t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_media, op3_pii, op4_language, op5_near_duplicates, op6_sharding, op7_mixing, op8_packing, op9_substrings, op10_neighbours, op11_prefix_trie, op12_alignment, op13_exact_search)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op13_exact_search": OP13_SQL}
