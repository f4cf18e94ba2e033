"""Benchmark decontamination: BM25 over the test items, every training passage as a query.

The items are indexed (term → postings with impacts). Impacts are divided by the
item's score against its own text, so 1 means "all of the item's terms" and one
threshold serves all items. Items are searched by length class (8 words, 16, 32, ...).
A passage is a window of twice the class's length, stepping by that length: an
occurrence of an item lies whole in one, and no longer item widens it.

Retrieval is block-max WAND on arrays, for many passages at once: the sum of the
terms' largest impacts drops passages, the sums of the largest impacts inside
each block of items drop blocks, and only what is left is scored. The bounds are
upper bounds, so everything above the threshold is retrieved. Retrieved pairs are
then verified: the passage must hold most word pairs of the item's answer (its last
sentence, or more if that is short) and of its question (what comes before).

The index is built on the driver for at most ``ITEM_BLOCK`` items and broadcast;
more items are indexed and searched block by block. Document frequencies, item count and
mean length are those of all items, so the blocks do not change a score.

Defined results: null and empty texts and items hold no terms and match nothing;
repeated items match alike; of repeated rows and of a document's passages the
best is reported per document and item; rows (items) with a null id match as one
document (item) without an id; empty tables give no rows. Other columns are not read by
:func:`contaminated` and pass through :func:`decontaminate`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import text as T
from weft.llm.registry import query
from weft.session import cut_lineage, spread_rows
from weft.sources.files import read_table

K1, B = 1.2, 0.75
SHORT = 8            # words of the shortest length class
THRESHOLD = 0.5      # of the item's score against itself
OVERLAP = 0.6        # share of the word pairs of question and answer
PART_WORDS = 5       # words of a question or an answer at least, if need be of several sentences
ITEM_BLOCK = 20_000  # items indexed at once
MAX_BLOCK = 16       # items that share one block maximum
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SCHEMA = "doc_id {}, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _hashes(text: str) -> np.ndarray:
    data, offsets = T.utf8(pa.array([text]))
    return T.Words(data, offsets).hashes(lower=True)


def question_answer(text: str) -> tuple[str, str]:
    """The item's last sentences with ``PART_WORDS`` words or more, and all before them; where that
    leaves too few words for a question, the text is cut after two thirds of its words."""
    parts = _SENTENCE.split(text.strip())
    cut = len(parts) - 1
    while cut > 0 and len(" ".join(parts[cut:]).split()) < PART_WORDS:
        cut -= 1
    if len(" ".join(parts[:cut]).split()) >= PART_WORDS:
        return " ".join(parts[:cut]), " ".join(parts[cut:])
    words = text.split()
    cut = max(1, len(words) * 2 // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _pairs(h: np.ndarray) -> np.ndarray:
    """Distinct word pairs; a single word stands for itself."""
    return np.unique(T.mix(h[:-1] * np.uint64(31) + h[1:]) if len(h) > 1 else T.mix(h))


def _rows(order: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(order, np.arange(n + 1))


class Index:
    """Impact-ordered postings of the items with per-term and per-block maxima."""

    def __init__(self, items: list[tuple[int, str]], longest: int | None = None, stats: tuple | None = None):
        """``longest`` is the length class; ``stats`` the (number, mean length, sorted terms, document
        frequencies) of a larger set of items that these are from."""
        items = [(i, t, h) for i, t in items if len(h := _hashes(t or ""))]
        self.ids = [i for i, _, _ in items]
        self.longest = longest or max((len(h) for _, _, h in items), default=1)
        self.parts = [tuple(_pairs(_hashes(p)) for p in question_answer(t)) for _, t, _ in items]
        item = np.repeat(np.arange(len(items)), [len(h) for _, _, h in items])
        term, number = np.unique(np.concatenate([h for _, _, h in items]) if items else np.zeros(0, np.uint64),
                                 return_inverse=True)
        self.terms = T.HashIndex(term)
        cell, tf = np.unique(number * max(len(items), 1) + item, return_counts=True)
        term_of, self.item = cell // max(len(items), 1), cell % max(len(items), 1)
        length = np.bincount(item, minlength=len(items))
        if stats is None:
            number, mean = len(items), length.mean() if len(items) else 1
            df = np.bincount(term_of, minlength=len(term))
        else:
            number, mean = stats[:2]
            df = stats[3][np.searchsorted(stats[2], term)]
        idf = np.log1p((number - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(mean, 1) if len(items) else 1)
        impact = idf[term_of] * tf * (K1 + 1) / (tf + norm[self.item]) if len(items) else np.zeros(0)
        own = np.bincount(self.item, impact, len(items))
        self.impact = impact / np.maximum(own[self.item], 1e-12) if len(items) else impact
        self.first = _rows(term_of, len(term))
        self.top = np.maximum.reduceat(self.impact, self.first[:-1]) if len(term) else np.zeros(0)
        block, at = np.unique(term_of * (1 << 32) + self.item // MAX_BLOCK, return_index=True)
        self.block, self.block_top = block % (1 << 32), (np.maximum.reduceat(self.impact, at) if len(at) else impact)
        self.block_first = _rows(block >> 32, len(term))
        self.n_blocks = len(items) // MAX_BLOCK + 1


def _expand(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the given rows of a compressed table, and which row each is of."""
    size = first[rows + 1] - first[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[rows][owner], owner


def retrieve(index: Index, h: np.ndarray, first: np.ndarray):
    """(text, first word, item, score) of all passages and items at or above the threshold."""
    step, width = index.longest, 2 * index.longest
    counts = np.diff(first)
    windows = np.maximum(1, -(-(counts - width) // step) + 1)
    windows[counts == 0] = 0
    base = np.cumsum(windows) - windows                    # number of each text's first passage
    hit = np.flatnonzero((number := index.terms.find(h)) >= 0)
    doc = np.searchsorted(first, hit, "right") - 1
    place = (hit - first[doc]) // step                     # a word lies in passages place - 1 and place
    n_terms = len(index.top)
    keys = [(base[doc] + p)[ok] * n_terms + number[hit][ok]
            for p in (place, place - 1) for ok in ((p >= 0) & (p < windows[doc]),)]
    key = np.unique(np.concatenate(keys))
    passage, term = key // n_terms, key % n_terms
    bound = np.bincount(passage, index.top[term], int(windows.sum()))
    some = bound[passage] >= THRESHOLD
    passage, term = passage[some], term[some]
    at, owner = _expand(index.block_first, term)
    cell, inverse = np.unique(passage[owner] * index.n_blocks + index.block[at], return_inverse=True)
    live = cell[np.bincount(inverse, index.block_top[at], len(cell)) >= THRESHOLD]
    alive = np.isin(passage, live // index.n_blocks)
    passage, term = passage[alive], term[alive]
    at, owner = _expand(index.first, term)
    ok = np.isin(passage[owner] * index.n_blocks + index.item[at] // MAX_BLOCK, live)
    at, owner = at[ok], owner[ok]
    pair, inverse = np.unique(passage[owner] * len(index.ids) + index.item[at], return_inverse=True)
    score = np.bincount(inverse, index.impact[at], len(pair))
    good = score >= THRESHOLD
    passage, item = pair[good] // max(len(index.ids), 1), pair[good] % max(len(index.ids), 1)
    text = np.searchsorted(base + windows, passage, "right")
    return text, (passage - base[text]) * step, item, score[good]


def _share(part: np.ndarray, passage: np.ndarray) -> float:
    return float(np.isin(part, passage).mean()) if len(part) else 1.0


def _terms(items: DataFrame) -> DataFrame:
    """Rows ``(h, n, words)``: how many items hold a term; without a term, the number of items with words
    and their words."""
    def run(batches):
        for batch in T.slices(batches):
            words = T.Words(*T.utf8(batch.column(0)))
            h, owner = words.hashes(lower=True), words.doc()
            order = np.lexsort((owner, h))
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(h[order].view(np.int64)) != 0) | (np.diff(owner[order]) != 0)
            term, n = np.unique(h[order][new], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *term.view(np.int64).tolist()], pa.int64()),
                 pa.array([int((words.counts > 0).sum()), *n.tolist()], pa.int64()),
                 pa.array([len(h)] + [0] * len(term), pa.int64())], ["h", "n", "words"])

    return (items.select("text").mapInArrow(run, "h long, n long, words long")
            .groupBy("h").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))


def _indexes(items: DataFrame, terms: DataFrame, whole: bool) -> list[Index]:
    """An index per length class of a block of items."""
    total = terms.where("h is null").collect()
    own = terms if whole else terms.join(_terms(items).select("h"), "h", "left_semi")
    found = own.where("h is not null").select("h", "n").collect()  # the terms of at most ITEM_BLOCK items
    h, n = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(h)
    number = total[0]["n"] if total else 0
    stats = (number, total[0]["words"] / max(number, 1) if total else 1, h[order], n[order])
    classes: dict[int, list] = {}
    for item, text in items.orderBy("item_id", "text").collect():
        size = len(_hashes(text or ""))
        if size:
            classes.setdefault(max(SHORT, 1 << (size - 1).bit_length()), []).append((item, text))
    return [Index(classes[k], k, stats) for k in sorted(classes)]


def _search(docs: DataFrame, indexes: list[Index]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(indexes)  # at most ITEM_BLOCK items

    def run(batches):
        for batch in T.slices(batches):
            data, offsets = T.utf8(batch.column(1))
            words = T.Words(T.LOWER[data], offsets)
            h = words.hashes()
            out = []
            for ix, text, start, item, score in ((ix, *row) for ix in shared.value for row in zip(
                    *(x.tolist() for x in retrieve(ix, h, words.first)))):
                a = words.first[text] + start
                inside = _pairs(h[a:min(a + 2 * ix.longest, words.first[text + 1])])
                question, answer = (_share(p, inside) for p in ix.parts[item])
                if question >= OVERLAP and answer >= OVERLAP:
                    out.append((text, ix.ids[item], score, question, answer, start))
            if out:
                rows = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[0])), pa.array(rows[1], pa.int64()),
                     *(pa.array(c, pa.float64()) for c in rows[2:5]), pa.array(rows[5], pa.int64())],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(
        run, _SCHEMA.format(kind))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best passage of every document and test item that match: one row per pair."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n_blocks = max(1, -(-items.count() // ITEM_BLOCK))
    terms = cut_lineage(_terms(items))
    found = None
    for k in range(n_blocks):  # the stated query set, in blocks
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k
        part = _search(docs, _indexes(items.where(mine), terms, n_blocks == 1))
        found = part if found is None else found.union(part)
    rest = ["score", "question_overlap", "answer_overlap", "first_word"]
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("first_word")).alias("first_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", *[F.col(f"b.{c}") for c in rest[:-1]], (-F.col("b.first_word")).alias("first_word"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text holds no test item; a row is known by its id, null included, and its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.md5(text))
    gone = contaminated(docs.select(row.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, row == gone["_gone"], "left_anti")


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
