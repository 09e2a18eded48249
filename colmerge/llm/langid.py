"""Language identification of texts as mixtures of languages.

Learning: byte trigrams inside words (ASCII letters in lower case, other bytes of UTF-8 as they are), hashed into ``BINS`` bins, are counted per
language over all labelled rows, by partial sums in the tasks. The model is one row of log-probabilities per language.

Prediction: a word's likelihood under a language is the product of its trigrams' probabilities. Expectation-maximisation estimates the
proportions of the languages over the document's words, until a round raises the log-likelihood by no more than ``TOLERANCE``. Languages are
ranked by proportion; for the first 1, 2, ... of them the mixture is fitted again, and the set with the best penalised likelihood (-2 log-likelihood
+ number of free proportions * log words) is chosen. A document's search ends where no larger set can be better: the likelihood of any mixture is bounded from the
one of all languages (the log-likelihood is concave in the proportions), and the penalty grows with the set.

Whether a text is in the learned languages at all is told by its evidence: the mixture's log-likelihood per trigram, less that of a background in which
all bins are as likely. ``least_evidence`` learns from the labelled rows' counts how much of it there must be.

Cases: a null text, or one without a letter, is ``und`` with score 0 and no languages, as is every text if nothing was learned; rows with a null
label don't teach; repeated rows teach as often as they occur; texts are read whole; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colmerge.llm.common import unused
from colmerge.llm.textvec import slices, text_column

BINS = 1 << 14
SMOOTHING = 0.5
#: Languages that one model may have: a hard error beyond, as the model is held by every task.
MOST_LANGUAGES = 1000
TOLERANCE = 1e-3
#: Standard errors that a text's evidence must lie below the least to count as foreign, so that short texts aren't rejected by chance.
SURE = 3.0
UNDETERMINED = "und"

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # bins x languages


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of the trigram around each letter, its row, first of each word)."""
    letters = _LETTERS[data]
    first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    before, behind = np.empty_like(letters), np.empty_like(letters)
    before[1:], behind[:-1] = letters[:-1], letters[1:]
    before[first] = behind[last] = 32
    at = np.flatnonzero(letters != 32)
    code = (before[at].astype(np.uint32) << 16) | (letters[at].astype(np.uint32) << 8) | behind[at]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int64)
    row = np.searchsorted(offsets, at, side="right") - 1
    return bins, row, np.flatnonzero(before[at] == 32)


def learn(labelled: DataFrame, label: str = "lang", text: str = "text") -> Model:
    """The model of all rows of ``labelled`` whose label isn't null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            column = text_column(batch, "text")
            names = sorted(set(labels))
            place = np.array([names.index(x) for x in labels])
            for at, end, data, offsets in slices(column):
                if len(data):
                    bins, row, _ = trigrams(data, offsets)
                    table = np.bincount(place[at:end][row] * BINS + bins, minlength=len(names) * BINS).reshape(len(names), BINS)
                    for name, counted in zip(names, table, strict=True):
                        sums[name] = sums[name] + counted if name in sums else counted
        for name, counted in sums.items():
            used = np.flatnonzero(counted)
            yield pa.record_batch([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counted[used], pa.int64())], ["label", "bin", "n"])

    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).filter("label is not null and text is not null")
    sums = rows.mapInArrow(count, "label string, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))
    # BINS numbers per language at most, whatever the size of the corpus; as Arrow columns, 20 bytes or so for each number
    found = sums.limit(MOST_LANGUAGES * BINS + 1).toArrow().combine_chunks()
    languages = sorted(pc.unique(found["label"]).to_pylist())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((BINS, len(languages)), SMOOTHING)
    for k, name in enumerate(languages):
        own = found.filter(pc.equal(found["label"], name))
        table[own["bin"].to_numpy(), k] += own["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _fit(likely: np.ndarray, words: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages and log-likelihood of each document (``words`` rows of ``likely`` each), by expectation-maximisation to ``TOLERANCE``."""
    share, total = share.copy(), np.zeros(len(words))
    at, before = np.arange(len(words)), np.full(len(words), -np.inf)
    while len(at):
        first = np.cumsum(words) - words
        joint = likely * np.repeat(share[at], words, axis=0)
        sums = joint.sum(axis=1)
        now = total[at] = np.add.reduceat(np.log(sums), first)
        moving = now - before > TOLERANCE
        if not moving.all():
            kept = np.repeat(moving, words)
            likely, joint, sums, at, now, words = likely[kept], joint[kept], sums[kept], at[moving], now[moving], words[moving]
            first = np.cumsum(words) - words
        if len(at):
            share[at] = np.add.reduceat(joint / sums[:, None], first, axis=0) / words[:, None]
        before = now
    return share, total


def _most_likely(likely: np.ndarray, words: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A bound on the log-likelihood of each document under any mixture, from that of ``share``.

    With gradients g, no mixture's likelihood is more than (max g / n) ** n times that of ``share``: by Jensen, for n words.
    """
    first = np.cumsum(words) - words
    sums = (likely * np.repeat(share, words, axis=0)).sum(axis=1)
    gradient = np.add.reduceat(likely / sums[:, None], first, axis=0).max(axis=1)
    return np.add.reduceat(np.log(sums), first) + words * np.log(gradient / words)


def least_evidence(model: Model) -> tuple[float, float]:
    """(evidence that a text in the learned languages has at least, standard deviation of one trigram's).

    The least lies halfway between the labelled rows of the language with the least evidence under its own model, and the most that those of any
    language have under another's (or the background under any); but not above half of the former, as labels may name one language twice.
    """
    if not model.languages:
        return 0.0, 0.0
    logs = model.logs.astype(np.float64)
    p, background = np.exp(logs), np.log(BINS)
    crossed = p.T @ logs + background
    own = crossed.diagonal().copy()
    spread = np.sqrt(np.maximum((p * logs**2).sum(axis=0) - (own - background) ** 2, 0.0)).max()
    np.fill_diagonal(crossed, -np.inf)
    other = max(crossed.max(), (logs.mean(axis=0) + background).max())
    return float(min((own.min() + other) / 2, own.min() / 2)), float(spread)


def mixtures(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Shares of the model's languages in each row; zero for languages outside the chosen set, and for rows without a letter."""
    return fitted(data, offsets, model)[0]


def fitted(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(``mixtures``, evidence, number of trigrams) of each row."""
    shares = np.zeros((len(offsets) - 1, len(model.languages)))
    evidence, sizes = np.zeros(len(shares)), np.zeros(len(shares), np.int64)
    if not len(data) or not model.languages:
        return shares, evidence, sizes
    bins, row, word = trigrams(data, offsets)
    if not len(bins):
        return shares, evidence, sizes
    logs = np.add.reduceat(model.logs[bins], word, axis=0)
    top = logs.max(axis=1, keepdims=True)
    likely = np.exp(np.maximum(logs - top, -60.0)).astype(np.float64)
    used, first, words = np.unique(row[word], return_index=True, return_counts=True)
    single = np.add.reduceat(logs.astype(np.float64), first)
    fixed = np.add.reduceat(top[:, 0].astype(np.float64), first)
    full, _ = _fit(likely, words, np.full((len(used), len(model.languages)), 1.0 / len(model.languages)))
    best = np.zeros_like(full)
    best[np.arange(len(used)), single.argmax(axis=1)] = 1.0
    likelihood = single.max(axis=1)
    cost = -2 * likelihood
    order = np.argsort(-full, axis=1, kind="stable")
    at, most = np.arange(len(used)), _most_likely(likely, words, full) + fixed
    for k in range(2, len(model.languages) + 1):
        # sets of k or more languages that may still be better, by more than rounding
        open_ = -2 * most[at] + (k - 1) * np.log(words[at]) < cost[at] - 1e-9 * np.abs(cost[at])
        likely, at = likely[np.repeat(open_, words[at])], at[open_]
        if not len(at):
            break
        chosen = order[at, :k]
        start = np.maximum(np.take_along_axis(full[at], chosen, axis=1), 1e-9)
        share, total = _fit(np.take_along_axis(likely, np.repeat(chosen, words[at], axis=0), axis=1), words[at], start / start.sum(axis=1, keepdims=True))
        now = -2 * (total + fixed[at]) + (k - 1) * np.log(words[at])
        better = now < cost[at]
        found = at[better]
        cost[found], best[found], likelihood[found] = now[better], 0.0, (total + fixed[at])[better]
        best[found[:, None], chosen[better]] = share[better]
    shares[used], sizes = best, np.bincount(row, minlength=len(shares))
    evidence[used] = likelihood / sizes[used] + np.log(BINS)
    return shares, evidence, sizes


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None, known: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the share of that language) and ``lang_mix``, an array of (lang, share).

    ``keep`` names the columns that pass through; all of them by default. Input columns named like the output are replaced.
    ``known`` names a further column: whether there is evidence enough that the text is in the learned languages.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    given = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "lang_mix", known)]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # the text goes to the tasks once, even if it is kept
    passed = given if text in given else [*given, text]
    rows = docs.select(*passed, F.when(body.rlike(r"\p{L}"), True).alias(*unused(docs.columns, "letters")))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        least, spread = least_evidence(learned)
        limit = max(1 << 16, (1 << 20) * 4 // max(4, len(learned.languages)))
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).is_valid()
            column = pc.if_else(letters, text_column(batch, text), pa.scalar("", pa.large_string()))
            parts = [fitted(data, offsets, learned) for _, _, data, offsets in slices(column, limit)]
            shares = np.concatenate([x for x, _, _ in parts]) if parts else np.zeros((0, len(learned.languages)))
            none = shares.sum(axis=1) == 0
            place = shares.argmax(axis=1) if learned.languages else np.zeros(len(shares), int)
            names = np.array([*learned.languages, UNDETERMINED], dtype=object)
            place[none] = len(learned.languages)
            score = np.where(none, 0.0, np.minimum(1.0, shares.max(axis=1, initial=0.0)))
            r, c = np.nonzero(shares)
            ends = np.searchsorted(r, np.arange(len(shares) + 1))
            items = pa.StructArray.from_arrays([pa.array(names[c], pa.string()), pa.array(shares[r, c])], ["lang", "share"])
            mix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items).cast(kind)
            kept = [batch.column(k) for k in range(len(given))]
            out = [*kept, pa.array(names[place], pa.string()), pa.array(score), mix]
            if known:
                evidence, sizes = (np.concatenate([part[k] for part in parts]) if parts else np.zeros(0) for k in (1, 2))
                out.append(pa.array(~none & (evidence + SURE * spread / np.sqrt(np.maximum(sizes, 1)) >= least), pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, [*given, *added.names])

    added = StructType.fromDDL("lang_pred string, score double, lang_mix array<struct<lang:string,share:double>>")
    if known:
        added = added.add(known, "boolean")
    schema = StructType(rows.schema.fields[: len(given)] + added.fields)
    return rows.mapInArrow(predict, schema)
