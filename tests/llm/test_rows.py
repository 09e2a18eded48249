"""Personal data, sharding, mixing, the pipeline and the registered queries."""

import collections
import hashlib
import math
import os
import random
import re
import struct
import time
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from colmerge.llm import common, mixing, pii, queries, sharding

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark, documents, awkward):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB1 2-.@+()9.3 4_é😀 5") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(rng.randint(10, 40))) for _ in range(800)]
    texts += ["a@b.c_x@d.e", "a@b.c@d.e.f", "a@b..c d@e.f.", "1.2.3.4.5.6.7.8", "001.002.0255.0", "4111 1111-1111 1111", "x" * 9000 + "@" + "c." * 9000 + "d", "1 " * 20000, "1" * 20000, "+1 " + "(" * 20000]
    texts += [r["text"] for r in documents.select("text").collect()] + [r["text"] for r in awkward.collect()]
    for r in pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in BASE] == base_spans(r["text"] or ""), repr((r["text"] or "")[:200])


def test_confirmed_accounts_and_context(spark):
    texts = ["my bank: GB82 WEST 1234 5698 7654 32 ok", "DE89370400440532013000", "DE88370400440532013000", "call me: +49 30 1234567", "zzzz +49 30 1234567"]
    rows = pii.redact(pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()
    assert [[(s["kind"], s["score"]) for s in r["pii"]] for r in rows] == [[("iban", 1.0)], [("iban", 0.8)], [], [("phone", 0.7)], [("phone", 0.5)]]
    assert rows[0]["text"] == "my bank: [IBAN] ok" and rows[3]["text"] == "call me: [PHONE]"


def test_accounts_before_capitals_numbers_and_other_accounts(spark):
    told = {
        "IBAN DE89370400440532013000 Bitte zahlen": ["DE89370400440532013000"],
        "Konto DE89 3704 0044 0532 0130 00 Bank": ["DE89 3704 0044 0532 0130 00"],
        "GB82 WEST 1234 5698 7654 32 BIC X": ["GB82 WEST 1234 5698 7654 32"],
        "GB82WEST12345698765432 2024": ["GB82WEST12345698765432"],
        "😀 NO93 8601 1117 947 FR1420041010050500013M02606 A": ["NO93 8601 1117 947", "FR1420041010050500013M02606"],
        "AB12 FR12 DE89370400440532013000 7": ["DE89370400440532013000"],
        "DE89370400440532013000X GB82WEST1234569876543": [],
    }
    for r in pii.redact(pii.find_pii(spark.createDataFrame([(t, t) for t in told], "whole string, text string"))).collect():
        assert [r["whole"][s["start"] : s["end"]] for s in r["pii"] if s["kind"] == "iban"] == told[r["whole"]], r["whole"]
        assert not any(x in r["text"] for x in told[r["whole"]])


def test_context_on_both_sides_and_names_that_clash(spark):
    texts = ["4111 1111 1111 1111 is my visa card", "4111 1111 1111 1111 xx", "DE89370400440532013000 belongs to my konto", "a@b.org zz c@d.org is my mail"]
    names = ["__text", "__digit", "__email", "Text_", "digit_", "IBAN_", "pii"]
    df = spark.createDataFrame([(t, *range(7)) for t in texts], ", ".join(["text string", *[f"`{n}` int" for n in names]]))
    rows = pii.find_pii(df).collect()
    assert [[(s["kind"], round(s["score"], 6)) for s in r["pii"]] for r in rows] == [[("card", 0.9)], [("card", 0.7)], [("iban", 1.0)], [("email", 0.8), ("email", 1.0)]]
    assert all([r[n] for n in names[:-1]] == list(range(6)) for r in rows)


def test_many_matches_in_one_text(spark):
    """More matches than a running sum takes at once, of all kinds, overlapping, with wide characters and a mark at the start of a part."""
    part = "\ufeff😀 a{k}@b.org \ufeffé 10.0.{k}.1 +49 30 12345{k} 4111 1111 1111 1111 DE89370400440532013000 "
    text = "".join(part.replace("{k}", str(k % 200)) for k in range(700))
    df = spark.createDataFrame([(text,), ("\ufeff",), (None,)], "text string")
    found = pii.find_pii(df)
    spans = found.filter("size(pii) > 0").first()["pii"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans if s["kind"] in BASE] == base_spans(text)
    assert sum(s["kind"] == "iban" for s in spans) == 700
    told, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"], s["kind"])):
        if s["start"] >= at:
            told += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    assert sorted(r["text"] or "" for r in pii.redact(found).collect()) == sorted(["", "\ufeff", "".join(told) + text[at:]])


def test_time_grows_with_the_matches(spark):
    took = []
    for n in (2000, 16_000):
        df = spark.createDataFrame([(" ".join(f"a{k}@b.org" for k in range(n)),)], "text string")
        began = time.perf_counter()
        assert pii.redact(pii.find_pii(df)).select(F.length("text")).first()[0] == n * 8 - 1
        took.append(time.perf_counter() - began)
    assert took[1] < 20


def test_redact_leaves_nothing(awkward):
    clean = pii.redact(pii.find_pii(awkward))
    assert not [r for r in clean.collect() if r["text"] and base_spans(r["text"])]
    assert pii.find_pii(awkward.limit(0)).count() == 0 and clean.count() == awkward.count()


def test_sharding(awkward, documents):
    for docs, shards in ((awkward, 3), (documents, 8), (awkward.limit(2), 8), (awkward.limit(0), 2)):
        rows = sharding.shard_rows(docs, shards).collect()
        texts = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[k]) for k in range(shards)]
        assert max(counts) - min(counts) <= 1


def brute_shards(ids, shards, seed, blocks, parts):
    """(shard, slot) of each row: hashes, matrix, both permutations, one row after the other."""

    def hashed(*values):
        h = 42
        for kind, v in values:
            h = xxhash.xxh64_intdigest(struct.pack(kind, v), h) if v is not None else h
        return h - 2**64 if h >= 2**63 else h

    first = [hashed(("<i", seed), ("<q", i), ("<q", k)) for k, i in enumerate(ids)]
    order = collections.defaultdict(list)
    for k in sorted(range(len(ids)), key=lambda k: first[k]):
        order[first[k] % blocks].append(k)
    matrix = sharding.communication_matrix([len(order[b]) for b in range(blocks)], shards, seed)
    held = collections.defaultdict(list)
    for b in range(blocks):
        of = [s for s in range(shards) for _ in range(matrix[b][s])]
        for k, s in zip(order[b], of, strict=True):
            second = hashed(("<i", seed + 1), ("<q", first[k]))
            held[s].append(((second % 2**64 >> 32) % parts, second, k))
    return {k: (s, slot) for s, rows in held.items() for slot, (_, _, k) in enumerate(sorted(rows))}


def test_sharding_row_by_row(spark):
    ids = [k * 3 for k in range(400)] + [None, 5, 5]
    df = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    place = {zlib.crc32(str(k).encode()): k for k in range(len(ids))}
    for blocks, parts in ((7, 3), (50, 1)):
        got = {place[r["text_crc32"]]: (r["shard"], r["slot"]) for r in sharding.shard_rows(df, 5, 11, blocks=blocks, parts=parts).collect()}
        assert got == brute_shards(ids, 5, 11, blocks, parts)


def test_sharding_is_uniform(spark):
    """Where a row comes from tells nothing of its shard or its slot."""
    n = 8000
    rows = sharding.shard_rows(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 8).collect()
    for cell in (lambda r: r["shard"], lambda r: r["slot"] * 8 // 1000):
        seen = collections.Counter((r["doc_id"] * 8 // n, cell(r)) for r in rows)
        chi = sum((seen[a, b] - n / 64) ** 2 / (n / 64) for a in range(8) for b in range(8))
        assert chi < 49 + 5 * math.sqrt(2 * 49)


def test_communication_matrix():
    sizes = [0, 5, 17, 100, 3, 0, 42]
    for seed in range(50):
        m = sharding.communication_matrix(sizes, 4, seed)
        assert [sum(r) for r in m] == sizes
        columns = [sum(c) for c in zip(*m, strict=True)]
        assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1


def test_hypergeometric_frequencies():
    rng, n = random.Random(1), 20_000
    seen = collections.Counter(sharding.hypergeometric(rng, 7, 9, 6) for _ in range(n))
    for k in range(7):
        p = math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_mixing(spark, awkward):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(1).alias("copy"))
    mixed = mixing.mix_sources(docs, {"a": 0.75, "b": 0.25, "nowhere": 3.0, "none": 0.0})
    counts = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {"a", "b"}
    assert abs(counts["a"] / counts["b"] - 3) < 0.3
    keys = [r["shuffle_key"] for r in mixed.collect()]
    assert keys == sorted(keys)
    drawn = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("m"), F.countDistinct("copy").alias("d")).collect()
    assert all(r["n"] == r["m"] == r["d"] for r in drawn)
    # 0.75 of 6000 rows from 2000
    zero = 1 - len([1 for r in drawn if r["doc_id"] % 3 == 0]) / 2000
    assert abs(zero - math.exp(-2.25)) < 0.03
    assert mixing.mix_sources(awkward).columns == [*awkward.columns, "copies", "copy", "shuffle_key"]
    clash = awkward.select("*", *[F.lit(k).alias(x) for k, x in enumerate(("__source", "__parts", "__cdf", "__u", "PARTS", "cdf", "salt", "range"))])
    assert mixing.mix_sources(clash).columns == [*clash.columns, "copies", "copy", "shuffle_key"]
    assert all([r[x] for x in clash.columns[-8:]] == list(range(8)) for r in mixing.mix_sources(clash).collect())
    assert mixing.mix_sources(awkward, {}).count() == 0 == mixing.mix_sources(awkward.limit(0)).count()


def test_a_small_source_of_large_weight_is_not_dropped(spark):
    docs = spark.range(6003).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "small").otherwise("large").alias("source"))
    mixed = mixing.mix_sources(docs, {"small": 0.5, "large": 0.5})
    got = {r["doc_id"]: (r["n"], r["m"]) for r in mixed.filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("m")).collect()}

    def inverted(key, rate):
        u, k = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52, 0
        total = p = math.exp(-rate)
        while u >= total:
            k += 1
            p *= rate / k
            total += p
        return k

    # a mean of 1000.5 in two parts
    told = {i: inverted(f"{i}:7", 500.25) + inverted(f"{i}:1:7", 500.25) for i in range(3)}
    assert got == {i: (n, n) for i, n in told.items()}
    assert all(abs(n - 1000.5) < 200 for n in told.values())
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"small": -1.0})


def test_many_sources_are_salted(monkeypatch, documents):
    whole = sorted(map(str, mixing.mix_sources(documents).select("doc_id", "copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixing.mix_sources(documents).select("doc_id", "copy").collect())) == whole


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = queries.op7_mixing(spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    told = con.sql(queries.OP7_SQL).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(told, key=str)


def test_pipeline(spark, tmp_path, documents):
    from test_groups import brute_components

    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "mixing", "packing"]
    docs, ids = documents, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "language":
            assert docs.count() == before.filter(F.col("text").rlike(r"\p{L}")).count()
        if name == "near_duplicates":
            told = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 0.8)
            assert {r["doc_id"] for r in docs.collect()} == {least for _, _, least in told}
        if name == "pii":
            assert docs.count() == before.count() and not [r for r in docs.collect() if base_spans(r["text"])]
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "mixing":
            assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before.collect()}
        if name != "packing":
            assert docs.columns == documents.columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
    assert ids[-1] == ids[-2]
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, again.select("doc_id", "start", "ids").collect())) == sorted(map(str, docs.select("doc_id", "start", "ids").collect()))


def test_run_computes_each_stage_once(spark, monkeypatch):
    counts = {name: spark.sparkContext.accumulator(0) for name, _ in corpus_pipeline.STAGES}

    def counted(name, stage):
        total = counts[name]

        def count(batches):
            for batch in batches:
                total.add(batch.num_rows)
                yield batch

        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            return out.mapInArrow(count, out.schema)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, counted(name, stage)) for name, stage in corpus_pipeline.STAGES])
    before = common.tables_written()
    rows = len(corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())
    assert counts["packing"].value == rows
    # of all that was written, the table that the last stage reads is left
    assert [os.path.exists(p) for p in common._TABLES[before:]] == [False] * (common.tables_written() - before - 1) + [True]
    kept = [counts[name].value for name in ("language", "near_duplicates", "pii")]
    assert 200 >= kept[0] > kept[1] == kept[2] > 0 and 0.7 * kept[2] < counts["mixing"].value < 1.3 * kept[2]


def test_pipeline_rejects_foreign_texts_and_junk_but_no_mixtures(spark, documents):
    rng = random.Random(3)
    words = collections.defaultdict(list)
    for r in documents.filter("text is not null and lang is not null").orderBy("doc_id").collect():
        words[r["lang"]] += r["text"].split()
    assert len(words) == 4
    extra = {
        -1: "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        -2: "все люди рождаются свободными и равными в своём достоинстве и правах они наделены разумом и совестью",
        -3: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzaeiou") for _ in range(rng.randint(2, 9))) for _ in range(60)),
        -4: " ".join(x for own in words.values() for x in own[:100]),
        -5: words["en"][0],
    }
    rows = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in extra.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.identify_language(spark, documents.select(corpus_pipeline.COLUMNS).unionByName(rows), "")
    assert {r["doc_id"] for r in found.filter("doc_id < 0").collect()} == {-4, -5}
    assert found.filter("doc_id >= 0").count() == documents.filter(F.col("text").rlike(r"\p{L}")).count()


def test_awkward_rows_pass_the_pipeline(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 0
        assert stage(spark, docs.limit(0), "").count() == 0
