"""Every column of the registered queries' contracts against direct versions, over whole tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_groups import brute_components, brute_repeats
from test_rows import base_spans

from colmerge.llm import langid, media, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def run(spark, name, *columns):
    return [tuple(r) for r in queries.queries()[name](spark, SF).select(*columns).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, texts):
    import sentencepiece

    count = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode
    told = [(i, len(t.encode()), n := len(count(t)), n > 4096) for i, t in texts.items()]
    assert sorted(run(spark, "op1_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit")) == sorted(told)


def test_op2(spark, texts):
    def told(t):
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        stored = media.write_matroska([payload[k : k + 576] for k in range(0, len(payload), 576)])
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), len(payload) // 576

    from pyspark.sql import functions as F

    got = run(spark, "op2_media", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.size("packets"))
    assert sorted(got) == sorted((i, *told(t)) for i, t in texts.items())
    feature = dict(run(spark, "op2_media", "doc_id", "feature"))
    assert all(f";packets:{told(t)[1] // 576};" in feature[i] and f";ms:{told(t)[1] // 8};" in feature[i] for i, t in texts.items())


def valid_account(x):
    x = re.sub("[^A-Z0-9]", "", x)
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_op3(spark, texts):
    for i, *counts, digest, spans in run(spark, "op3_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"):
        base = base_spans(texts[i])
        assert counts == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        assert digest == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        found = [x.split(":") for x in spans.split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in found if k != "iban"] == base
        assert all(valid_account(texts[i][int(a) : int(b)]) for k, a, b in found if k == "iban")
        # all accounts written without spaces are found
        plain = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9 ])", texts[i]) if valid_account(m[0])]
        assert set(plain) <= {(int(a), int(b)) for k, a, b in found if k == "iban"}


def brute_mixture(text, logs):
    """Shares of the languages by expectation-maximisation in plain loops, and the best of all sets by rank by penalised likelihood."""
    words = []
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
        word = re.sub(rb"[A-Z]", lambda m: m[0].lower(), word)
        around = b" " + word + b" "
        bins = [(int.from_bytes(around[k : k + 3], "big") * 2654435761 % 2**32) >> 18 for k in range(len(word))]
        words.append([sum(float(logs[b, k]) for b in bins) for k in range(logs.shape[1])])

    def fit(languages, share):
        before = -math.inf
        while True:
            total, sums = 0.0, [0.0] * len(languages)
            for w in words:
                top = max(w)
                joint = [s * math.exp(max(w[k] - top, -60.0)) for s, k in zip(share, languages, strict=True)]
                total += top + math.log(sum(joint))
                sums = [s + j / sum(joint) for s, j in zip(sums, joint, strict=True)]
            if total - before <= langid.TOLERANCE:
                return share, total
            share, before = [s / len(words) for s in sums], total

    n = logs.shape[1]
    single = [sum(w[k] for w in words) for k in range(n)]
    full, _ = fit(range(n), [1 / n] * n)
    best, cost = {max(range(n), key=lambda k: single[k]): 1.0}, -2 * max(single)
    order = sorted(range(n), key=lambda k: -full[k])
    for size in range(2, n + 1):
        start = [max(full[k], 1e-9) for k in order[:size]]
        share, total = fit(order[:size], [s / sum(start) for s in start])
        now = -2 * total + (size - 1) * math.log(len(words))
        if now < cost:
            best, cost = dict(zip(order[:size], share, strict=True)), now
    return best


def test_op4(spark, texts):
    docs = queries.documents(spark, SF)
    model = langid.learn(docs.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    known = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    right = total = 0
    for i, held, told, score, mix in run(spark, "op4_language", "doc_id", "held_out", "lang_pred", "score", "lang_mix"):
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not any(c.isalpha() for c in texts[i]):
            assert (told, score, mix) == ("und", 0.0, [])
            continue
        shares = {model.languages[k]: s for k, s in brute_mixture(texts[i], model.logs).items()}
        assert {m["lang"] for m in mix if m["share"] > 1e-6} == {x for x, s in shares.items() if s > 1e-6}
        assert all(abs(m["share"] - shares[m["lang"]]) < 1e-3 for m in mix) and abs(score - max(shares.values())) < 1e-3 and 0 <= score <= 1
        assert told == max(shares, key=shares.get) or abs(shares[told] - max(shares.values())) < 1e-3
        if held and known[i] and len(texts[i]) > 60:
            right, total = right + (told == known[i]), total + 1
    assert right >= 0.95 * total > 0


def test_mixtures_of_two_by_brute_force(texts):
    rng = np.random.default_rng(1)
    table = np.full((langid.BINS, 3), langid.SMOOTHING)
    parts = [t for t in texts.values() if len(t) > 400][:3]
    for k, t in enumerate(parts):
        data = np.frombuffer(t.encode(), np.uint8)
        np.add.at(table[:, k], langid.trigrams(data, np.array([0, len(data)]))[0], 1)
    model = langid.Model(["a", "b", "c"], np.log(table / table.sum(axis=0)).astype(np.float32))
    for _ in range(12):
        words = [w for t in parts for w in rng.permutation(t.split())[: rng.integers(0, 60)]] or ["x"]
        text = " ".join(words)
        data = np.frombuffer(text.encode(), np.uint8)
        got = langid.mixtures(data, np.array([0, len(data)]), model)[0]
        told = brute_mixture(text, model.logs)
        assert np.abs(got - [told.get(k, 0.0) for k in range(3)]).max() < 1e-3


def test_op5(spark, texts):
    got = run(spark, "op5_near_duplicates", "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got) == sorted((i, n, c, i == c) for i, n, c in brute_components(list(texts.items()), 3, 0.85))


def test_op6(spark, texts):
    got = run(spark, "op6_sharding", "doc_id", "size", "text_crc32", "law", "grown_shard", "shard", "slot")
    assert sorted(r[:5] for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in texts.items())
    slots = collections.defaultdict(list)
    for *_, shard, slot in got:
        slots[shard].append(slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op7(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    told = con.sql(queries.oracle_sql()["op7_mixing"])
    assert sorted(run(spark, "op7_mixing", *told.columns), key=str) == sorted(told.fetchall(), key=str)


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    told = []
    for i, t in texts.items():
        ids, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        sizes = [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]
        for n in sizes:
            told.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), 0))
            at += n
    assert sorted(run(spark, "op8_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")) == sorted(told)
    sequences = run(spark, "op8_packing", "sequence_id")
    assert len(set(sequences)) == len(told)


def test_op9(spark, texts):
    assert sorted(run(spark, "op9_substrings", "doc_id", "n_words", "n_removed", "kept_sha256"), key=str) == brute_repeats(list(texts.items()), 35)


def test_op10(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    got = collections.defaultdict(list)
    for q, rank, i, score in sorted(run(spark, "op10_neighbours", "query_id", "rank", "vec_id", "score")):
        assert rank == len(got[q]) + 1 and score == np.sqrt(((x[q] - x[i]) ** 2).sum())
        got[q].append((score, i))
    assert set(got) == {i for i in x if i % 100 == 0}
    hit = 0
    for q, own in got.items():
        assert own == sorted(own) and len(own) == 10
        hit += len(set(own) & set(sorted((np.sqrt(((x[q] - v) ** 2).sum()), i) for i, v in x.items() if i != q)[:10]))
    assert hit >= 0.9 * 10 * len(got)
