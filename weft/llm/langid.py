"""Language identification by mixture inference.

Training counts hashed letter trigrams per language, summed by Spark. For a
document, every word with a letter has a log-likelihood under each language;
expectation-maximisation estimates the document's language proportions from
them. Sets of the 1, 2, ... most probable languages are fitted in turn and the
set with the best log-likelihood less ``penalty * log(words)`` per language is
kept. The prediction is the language with the largest proportion in that set.

The model holds ``2**HASH_BITS`` numbers per language and at most
``MAX_LANGUAGES`` languages (more is an error), so its size does not follow the
corpus.

Defined results: null text, empty text and text without a Unicode letter give
``und`` with score 0, as does everything when there is nothing to learn from;
rows with a null ``lang`` are not learned from; a null id hashes like ``''``;
repeated rows are predicted (and learned from) one by one; ties go to the first
language by name; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import text as T
from weft.llm.registry import query
from weft.session import spread_rows
from weft.sources.files import read_table

HASH_BITS = 16
MAX_LANGUAGES = 256
MAX_SET = 3          # languages in one document's set
PENALTY = 2.0        # log-likelihood a further language must add, per log(words)
STEPS = 8            # rounds of expectation-maximisation
SMOOTHING = 0.05
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_BINS = 1 << HASH_BITS


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def trigrams(data: np.ndarray, words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each byte of each word (``_BINS`` where it is no letter) and the words'
    lengths. A feature hashes the byte with its neighbours; separators read as one space."""
    low = np.where(T._SEP[data], np.uint8(32), T.LOWER[data])
    inside = ~T._SEP[data]
    around = np.full(len(data) + 2, 32, np.uint8)
    around[1:-1] = low
    cut = words.offsets[1:-1]
    code = low.astype(np.uint32) << np.uint32(8)
    before, after = around[:-2].astype(np.uint32), around[2:].astype(np.uint32)
    at = cut[cut < len(data)]
    before[at] = 32                      # the text before is another document
    after[cut[cut > 0] - 1] = 32
    code |= before << np.uint32(16)
    code |= after
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)
    code[~_LETTER[data]] = _BINS
    return code[inside], words.end - words.start


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, shape (languages, bins + 1), from ``text`` and ``lang``."""
    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in T.slices(batches):
            langs = batch.column(1).to_pylist()
            data, offsets = T.utf8(batch.column(0))
            feature, length = trigrams(data, words := T.Words(data, offsets))
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            of = np.repeat(number[words.doc()], length)
            got = np.bincount(of * (_BINS + 1) + feature, minlength=len(names) * (_BINS + 1))
            for name, row in zip(names, got.reshape(len(names), -1)):
                seen[name] = seen.get(name, 0) + row
        for name, row in seen.items():
            at = np.flatnonzero(row[:_BINS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), T.int_array(at), T.int_array(row[at])],
                ["lang", "feature", "n"])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    n_langs = known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = (spread_rows(known).mapInArrow(count, "lang string, feature long, n long")
            .groupBy("lang", "feature").agg(F.sum("n").alias("n"))
            .groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("c")).orderBy("lang").collect())
    counts = np.zeros((len(rows), _BINS + 1))
    for k, row in enumerate(rows):
        pairs = np.array(row["c"], np.int64)
        counts[k, pairs[:, 0]] = pairs[:, 1]
    logp = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * _BINS)).astype(np.float32)
    logp[:, _BINS] = 0
    return [r["lang"] for r in rows], logp


def _fit(ll: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of every document under its allowed languages.
    ``ll`` has a row per language; documents own the columns ``first[d]:first[d + 1]``, none empty."""
    size = np.diff(first)
    share = allowed / allowed.sum(0)
    total = np.zeros(len(size))
    peak = ll.max(0)
    like = np.exp(ll - peak)
    for _ in range(STEPS):
        part = like * np.repeat(share.astype(np.float32), size, axis=1)
        whole = part.sum(0) + np.float32(1e-30)
        part /= whole
        share = np.add.reduceat(part, first[:-1], axis=1) / size
        share = np.where(allowed, np.maximum(share, 1e-9), 0)
        share /= share.sum(0)
    mixed = (like * np.repeat(share.astype(np.float32), size, axis=1)).sum(0) + np.float32(1e-30)
    total = np.add.reduceat(np.log(mixed).astype(np.float64) + peak, first[:-1])
    return share, total


def infer(column, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the best language (-1: none), its proportion, and which languages are in the set."""
    n_langs, n_docs = len(logp), len(column)
    best, score = np.full(n_docs, -1), np.zeros(n_docs)
    chosen = np.zeros((n_langs, n_docs), bool)
    data, offsets = T.utf8(column)
    words = T.Words(data, offsets)
    if not n_langs or not len(words.start):
        return best, score, chosen
    feature, length = trigrams(data, words)
    begin = np.cumsum(length) - length
    ll = np.stack([np.add.reduceat(row[feature], begin) for row in logp])
    some = np.add.reduceat((feature < _BINS).astype(np.int32), begin) > 0
    doc = words.doc()[some]
    ll = ll[:, some]
    if not len(doc):
        return best, score, chosen
    ids, first = np.unique(doc, return_index=True)
    size = np.diff(np.append(first, len(doc)))
    first = np.append(first, len(doc))
    # Texts whose only non-ASCII bytes are signs, not letters, hold no letter.
    ascii_letter = np.add.reduceat(((T.LOWER[data] >= 97) & (T.LOWER[data] <= 122)).astype(np.int32),
                                   np.minimum(offsets[:-1], len(data) - 1)) > 0
    real = np.array([ascii_letter[d] or any(c.isalpha() for c in data[offsets[d]:offsets[d + 1]].tobytes().decode())
                     for d in ids])

    def penalised(total, k):
        return total - PENALTY * k * np.log(size + 1)

    everything = np.ones((n_langs, len(ids)), bool)
    share, total = _fit(ll, first, everything)
    order = np.argsort(-share, axis=0, kind="stable")
    value, pick, allowed = np.full(len(ids), -np.inf), np.zeros((n_langs, len(ids))), np.zeros_like(everything)
    for k in range(min(MAX_SET, n_langs)):
        allowed = allowed.copy()
        allowed[order[k], np.arange(len(ids))] = True
        if k == 0:  # one language: no proportions to estimate
            alone = np.add.reduceat(ll, first[:-1], axis=1)
            got, gain = allowed.astype(float), alone[order[0], np.arange(len(ids))].astype(np.float64)
        else:
            got, gain = (share, total) if k + 1 == n_langs else _fit(ll, first, allowed)
        gain = penalised(gain, k + 1)
        better = gain > value
        value = np.where(better, gain, value)
        pick = np.where(better, got, pick)
    top = pick.argmax(0)
    best[ids] = np.where(real, top, -1)
    # The reported score is the language's proportion when no language is left out.
    score[ids] = np.where(real, np.clip(share[top, np.arange(len(ids))], 0, 1), 0)
    chosen[:, ids] = (pick > 0) & real
    return best, score, chosen


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``lang_pred``, ``score`` and the set ``languages`` for every row; ``doc_id`` and ``held_out`` pass through."""
    names, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)  # bounded: MAX_LANGUAGES * 2**HASH_BITS floats

    def run(batches):
        label = np.array([*names, UNKNOWN], object)
        for batch in T.slices(batches):
            best, score, chosen = infer(batch.column(2), shared.value)
            member, rows = np.nonzero(chosen.T)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(label[best], pa.string()), pa.array(score, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(chosen.sum(0))), pa.int32()),
                                          pa.array(label[rows], pa.string()))],
                ["doc_id", "held_out", "lang_pred", "score", "languages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread_rows(docs.select("doc_id", "held_out", "text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    return predict(docs, train(docs.where(~F.col("held_out"))))
