"""Alignment of two tokenizers against a direct version that asks the libraries for whole texts."""

import collections
import hashlib
import itertools
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from colmerge.llm import queries
from colmerge.llm.alignment import Aligner, align, possible_pairs

FILES = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
SF = "/root/testdata/sf0.001"


def byte_of_sign():
    """The byte that each sign of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def direct():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, signs = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[2]), byte_of_sign()
    a.encode_special_tokens = True

    def one(text):
        """groups, number of tokens of each, linked pairs of occurrences."""
        if not text:
            return "", 0, 0, []
        told = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(signs[c] for c in t)) for i, t in zip(told.ids, told.tokens, strict=True)]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        full = (" " + text).encode()
        if any(b"".join(x for _, x in side) != full for side in (left, right)):
            return "", 0, 0, []
        by_end = [dict(zip(itertools.accumulate(len(x) for _, x in side), range(len(side)), strict=True)) for side in (left, right)]
        groups, links, at, to = [], [], 0, 0
        for end in sorted(by_end[0].keys() & by_end[1].keys()):
            i, j = by_end[0][end], by_end[1][end]
            groups.append(",".join(str(k) for k, _ in left[at : i + 1]) + "|" + ",".join(str(k) for k, _ in right[to : j + 1]))
            links.append((left[i][0], right[j][0]))
            at, to = i + 1, j + 1
        return ";".join(groups), len(left), len(right), links

    return one


def measures(rows, one):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of rows (id, text)."""
    known = {t: one(t) for t in {t for _, t in rows}}
    counts = collections.Counter(p for _, t in rows for p in known[t][3])
    highest = collections.Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    out = []
    for i, t in rows:
        groups, a, b, links = known[t]
        out.append((i, a, b, groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), groups))
    return sorted(out, key=str)


def test_odd_texts_align_as_the_libraries_say(direct):
    aligner = Aligner(*FILES)
    rng = random.Random(3)
    signs = ["a", "b", "the", "  ", " ", " ", " ", "\n", "\t", "é", "漢", "😀", "▁", "<|endoftext|>", "<s>", "<unk>", "\x00", "1", "23", ".", "'s", "X", " the", "́", "﻿", "<0x41>"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        groups, a, b, _ = aligner.align(text)
        assert (groups, a, b) == direct(text)[:3], repr(text)


def test_a_text_that_a_tokenizer_changes_has_no_tokens(direct):
    assert direct("a▁b")[:3] == ("", 0, 0)
    assert Aligner(*FILES).align("a▁b") == ("", 0, 0, b"")
    assert Aligner(*FILES).align("") == ("", 0, 0, b"")


def test_pairs_are_those_of_which_one_ends_with_the_other():
    a, b = [b"ab", b"b", b""], [b"b", b"xab", b"c", b"b"]
    told = [i * 4 + j for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))]
    assert possible_pairs(a, b).tolist() == told


def test_awkward_table(spark, awkward, direct):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = align(awkward, *FILES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == measures(rows, direct)
    assert align(awkward.limit(0), *FILES).collect() == []


def test_a_long_text_without_a_space_and_many_copies(spark, direct):
    rows = [(i, "two words") for i in range(500)] + [(1000, "x1" * 6000), (1001, "\n" * 3000), (1002, "words two"), (None, "two words")]
    assert sorted((tuple(r) for r in align(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).collect()), key=str) == measures(rows, direct)


def test_op12(spark, direct):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    told = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in measures(rows, direct)]
    df = queries.queries()["op12_alignment"](spark, SF)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(told, key=str)
