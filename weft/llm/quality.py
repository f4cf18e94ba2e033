"""Quality rules as a short-circuit cascade.

Every rule looks at whole texts and rejects some of them. Before a run, each
rule's cost and rejection rate are measured on a bounded sample, and the rules
are ordered by rejections per second. In the run a text that one rule rejects
is not seen by the later ones. The order changes how much work is done, never
the verdict: a text is kept exactly when no rule rejects it.

Defined results: null and empty texts have no words and are rejected by
``few_words``; any column may be null; repeated rows are judged one by one;
an empty table gives an empty table; other columns of the input, whatever
their names, pass through :func:`filter_quality` unchanged and are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import text as T
from weft.llm.registry import query
from weft.session import spread_rows
from weft.sources.files import read_table

SAMPLE_ROWS = 2048  # rows on which costs and rejection rates are measured
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # not a UTF-8 continuation byte
_UPPER, _LOWERCASE, _LETTER, _BANG = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LOWERCASE[97:123] = True
_LETTER[:] = _UPPER | _LOWERCASE | (np.arange(256) >= 0x80)
_BANG[ord("!")] = True


class Texts:
    """Features of a batch of texts, each computed when a rule first asks for it."""

    def __init__(self, column):
        self.column = column
        self.data, self.offsets = T.utf8(column)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def count(self, table: np.ndarray) -> np.ndarray:
        return self.per_text(table[self.data])

    @cached_property
    def words(self) -> T.Words:
        return T.Words(self.data, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count(_HEAD & ~T._SEP)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of the lines that hold a word."""
        n = len(self.offsets) - 1
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.offsets[:-1], breaks + 1])
        owner = np.concatenate([np.arange(n), np.searchsorted(self.offsets, breaks, "right") - 1])
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        end = np.append(start[1:] - 1, 0)
        last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
        end = end[:len(start)]
        end[last] = self.offsets[1:][owner[last]]
        some = np.searchsorted(self.words.start, end) > np.searchsorted(self.words.start, start)
        return start[some], end[some], owner[some]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[2], minlength=len(self.offsets) - 1)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        start, end, owner = self.lines
        key = T.mix(T.span_hashes(self.data, start, end) + T.mix(owner.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        return np.bincount(owner[order][1:][same], minlength=len(self.offsets) - 1)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside 8-word windows that occur twice or more in their text."""
        words = self.words
        window, at = T.shingles(words.hashes(), words.first, 8)
        owner = np.searchsorted(words.first, at, "right") - 1
        key = T.mix(window + T.mix(owner.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(words.start) + 9, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 8, -1)
        inside = np.cumsum(cover)[:len(words.start)] > 0
        total = np.zeros(len(inside) + 1, np.int64)
        np.cumsum(inside, out=total[1:])
        return total[words.first[1:]] - total[words.first[:-1]]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


# The two base rules are part of the query's contract; the others look for
# shouting, markup and tables, boilerplate and text that is not prose.
RULES = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > 2 * t.n_words),
    Rule("dup_lines", lambda t: (t.n_dup_lines > 1) & (100 * t.n_dup_lines > 30 * t.n_lines)),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 25 * t.n_words)),
    Rule("upper_case", lambda t: t.count(_UPPER) > t.count(_LOWERCASE) + t.count(np.arange(256) >= 0xC0)),
    Rule("exclamations", lambda t: 5 * t.count(_BANG) > t.n_words),
    Rule("letters", lambda t: 2 * t.count(_LETTER) < t.count(~T._SEP)),
)


def cascade(column, rules) -> np.ndarray:
    """True for the texts no rule rejects; each rule sees only what is left."""
    alive = np.arange(len(column))
    for rule in rules:
        if not len(alive):
            break
        texts = column if isinstance(column, Texts) else Texts(column)
        good = ~rule.rejects(texts)
        column = texts if good.all() else texts.column.filter(pa.array(good))
        alive = alive[good]
    return alive


def measure(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, int, int, float]]:
    """(rule, sampled rows, rejected, seconds) of each rule on a bounded sample."""
    sample = docs.select(F.col("text").cast("string").alias("text"))
    sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 3).limit(sample_rows)

    def run(batches):
        for batch in T.slices(batches):
            rows = []
            for rule in rules:
                began = time.perf_counter()
                bad = int(rule.rejects(Texts(batch.column(0))).sum())
                rows.append((rule.name, batch.num_rows, bad, time.perf_counter() - began))
            yield pa.RecordBatch.from_pylist([dict(zip(("rule", "n", "bad", "s"), r)) for r in rows])

    found = (sample.mapInArrow(run, "rule string, n long, bad long, s double")
             .groupBy("rule").agg(F.sum("n"), F.sum("bad"), F.sum("s")).collect())
    return [tuple(r) for r in found]


def ordered_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per second on the sample, most first."""
    gain = {name: bad / max(s, 1e-9) for name, _, bad, s in measure(docs, rules, sample_rows)}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def filter_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` whose text no rule rejects, all columns unchanged."""
    order = ordered_rules(docs, rules)

    def run(batches):
        for batch in T.slices(batches):
            alive = cascade(batch.column(batch.schema.get_field_index("text")), order)
            yield batch.take(pa.array(alive))

    return spread_rows(docs).mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per document: the base statistics, ``base_failed`` and the cascade's verdict ``kept``."""
    order = ordered_rules(docs, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in T.slices(batches):
            texts = Texts(batch.column(1))
            failed = (texts.n_words < 20) | (100 * texts.n_repeat_words > 30 * texts.n_words)
            kept = np.zeros(batch.num_rows, bool)
            left = np.flatnonzero(~failed)
            kept[left[cascade(batch.column(1).take(pa.array(left)), order)]] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(T.int_array(getattr(texts, n).astype(np.int64)) for n in names),
                 pa.array(failed), pa.array(kept)], ["doc_id", *names, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return spread_rows(docs.select("doc_id", "text")).mapInArrow(run, schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1
), inside AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(inside.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower,
    length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS wide, strlen(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS wide_bytes,
    length(regexp_replace(t, '[^!]', '', 'g')) AS bangs, coalesce(list_sum(list_transform(w, lambda x: strlen(x))), 0) AS bytes
  FROM d LEFT JOIN inside USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 2 * n_words
    OR (n_dup_lines > 1 AND 100 * n_dup_lines > 30 * n_lines) OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR upper > lower + wide OR 5 * bangs > n_words OR 2 * (upper + lower + wide_bytes) < bytes) AS kept
FROM s
"""


@query("op5_quality_rules", ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"))
