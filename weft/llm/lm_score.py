"""Language-model scoring with a hashed, class-factored maximum-entropy model.

P(word | history) = P(class | history) * P(word | class). Words get classes of
about equal mass by frequency; all words outside the ``MAX_TOP`` most frequent
ones, and the unknown word, share the last class. P(word | class) is the
smoothed share of the word in its class. P(class | history) is a softmax over
hashed n-gram and skip features of the preceding words (previous word, the one
before it, the pair), added to the log share of each class. Without weights the
score is therefore the base score, and the weights are what training adds.

* Counting: every task counts its distinct words, Spark sums them. The table of
  counts grows with the corpus and stays distributed.
* Training: every task runs mini-batch gradient updates over its training
  texts; Spark averages the tasks' weights by how often a row was updated, in two
  levels, streaming over blocks of the weight table.
* Scoring: a task needs the weights and the most frequent words (both of fixed
  size). The counts of a text's other words are joined from the count table.

Defined results: null text is empty and has one token, the end; a null id hashes
like ``''``; repeated rows are scored (and learned from) one by one; with no
training text every token is unknown and has probability 1; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import text as T
from weft.llm.langid import fold
from weft.llm.registry import query
from weft.session import cut_lineage, spread_rows
from weft.sources.files import read_table

MAX_TOP = 1 << 17     # words whose counts are broadcast; the others' counts are joined
CLASSES = 32
ROWS = 1 << 15        # rows of the weight table
BLOCK = 1 << 9        # rows per block when weights are averaged
MINI = 1 << 14        # tokens per gradient update
RATE, DAMPING = 0.1, 2.0
END = T.mix_int(0xE0D)
_START = np.uint64(T.mix_int(0x57A47))
_FLUSH = 1 << 22      # words a task gathers before it counts them


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token (words, then the end, of each text), each token's context key
    for rare words (its last bytes), and the texts' boundaries in them."""
    data, offsets = T.utf8(column)
    low = T.LOWER[data]
    words = T.Words(low, offsets)
    n = len(column)
    place = np.arange(len(words.start)) + words.doc()
    out = np.full(len(words.start) + n, END, np.uint64)
    out[place] = words.hashes()
    tail = np.zeros(len(out), np.uint64)
    for k in range(1, 4):
        at = np.maximum(words.end - k, words.start)
        tail[place] = tail[place] * np.uint64(257) + low[at]
    return out, T.mix(tail), words.first + np.arange(n + 1)


class Model:
    """What a scoring or training task needs: frequent words, their counts and classes, class shares, weights."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_tokens: int, n_types: int):
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        self.vocabulary, self.counts = T.HashIndex(hashes), counts
        self.n_tokens, self.n_types = n_tokens, n_types
        self.mass = n_tokens + 0.5 * (n_types + 1)
        own = counts + 0.5
        top = own.sum()
        self.word_class = np.minimum((np.cumsum(own) - own) * (CLASSES - 1) / max(top, 1e-9),
                                     CLASSES - 2).astype(np.int64)
        share = np.bincount(self.word_class, own, CLASSES).astype(float)
        share[CLASSES - 1] = self.mass - top
        share = np.maximum(share, 1e-300) / self.mass
        self.log_share = np.log(share).astype(np.float32)
        self.share = share.astype(np.float32)
        self.weights = np.zeros((ROWS, CLASSES), np.float32)

    def classes(self, number: np.ndarray) -> np.ndarray:
        return np.where(number >= 0, self.word_class[number] if len(self.word_class) else 0, CLASSES - 1)

    def features(self, h: np.ndarray, tail: np.ndarray, number: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Rows of the weight table for the previous word, the skip word and their pair."""
        key = np.where(number >= 0, h, tail)
        one, two = np.full(len(key), _START), np.full(len(key), _START)
        one[1:], two[2:] = key[:-1], key[:-2]
        one[first[:-1]] = _START
        two[first[:-1]] = _START
        second = first[:-1] + 1
        two[second[second < first[1:]]] = _START
        pair = T.mix(one * np.uint64(31) + two)
        rows = np.uint64(ROWS - 1)
        return [(x & rows).astype(np.int64) for x in (T.mix(one ^ np.uint64(1)), T.mix(two ^ np.uint64(2)), pair)]

    def logits(self, rows: list[np.ndarray], a: int, b: int) -> np.ndarray:
        out = self.weights[rows[0][a:b]]
        out += self.weights[rows[1][a:b]]
        out += self.weights[rows[2][a:b]]
        out += self.log_share
        out -= out.max(1, keepdims=True)
        return out

    def gains(self, rows: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
        """log10 P(class | history) - log10 P(class) of every token."""
        out = np.empty(len(classes))
        for a in range(0, len(classes), MINI):
            b = min(a + MINI, len(classes))
            logits = self.logits(rows, a, b)
            own = logits[np.arange(b - a), classes[a:b]]
            out[a:b] = own - np.log(np.exp(logits).sum(1)) - self.log_share[classes[a:b]]
        return out / np.log(10)

    def learn(self, rows: list[np.ndarray], classes: np.ndarray, seen: np.ndarray) -> None:
        """Mini-batch gradient ascent on the log-likelihood; ``seen`` counts updates per row.
        A row's step is its summed gradient over the expected count of each class."""
        for a in range(0, len(classes), MINI):
            b = min(a + MINI, len(classes))
            error = self.logits(rows, a, b)
            np.exp(error, out=error)
            error /= -error.sum(1, keepdims=True)
            error[np.arange(b - a), classes[a:b]] += 1
            for f in rows:
                order = np.argsort(f[a:b], kind="stable")
                row, at = np.unique(f[a:b][order], return_index=True)
                n = np.diff(np.append(at, b - a))
                total = np.add.reduceat(error[order], at, axis=0)
                self.weights[row] += RATE * total / (n[:, None] * self.share + np.float32(DAMPING))
                seen[row] += n


def count_words(train: DataFrame) -> DataFrame:
    """(h, n): occurrences of every distinct token in the training texts."""
    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([T.int_array(h.view(np.int64)), T.int_array(n)], ["h", "n"])

        for batch in T.slices(batches):
            held.append(tokens(batch.column(0))[0])
            if sum(map(len, held)) >= _FLUSH:
                yield flush()
        if held:
            yield flush()

    return (spread_rows(train.select("text")).mapInArrow(run, "h long, n long")
            .groupBy("h").agg(F.sum("n").alias("n")))


def start_model(counts: DataFrame, max_top: int = MAX_TOP) -> Model:
    """Totals and the at most ``max_top`` most frequent words; a histogram of counts sets their least count."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect()
    kept, lowest = 0, None
    for row in sorted(levels, key=lambda r: -r["level"]):
        kept += row["types"]
        if kept > max_top:
            break
        lowest = row["level"]
    top = counts.where(level >= lowest).toPandas() if lowest is not None else None
    h = np.zeros(0, np.uint64) if top is None else top["h"].to_numpy(np.int64).view(np.uint64)
    n = np.zeros(0) if top is None else top["n"].to_numpy(np.float64)
    return Model(h, n, sum(r["n"] for r in levels), sum(r["types"] for r in levels))


def train_weights(train: DataFrame, model: Model) -> np.ndarray:
    """One pass of gradient updates in every task, weights averaged by the rows' update counts."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    n_blocks = ROWS // BLOCK

    def run(batches):
        m: Model = shared.value
        m.weights = np.zeros((ROWS, CLASSES), np.float32)
        seen = np.zeros(ROWS, np.int64)
        for batch in T.slices(batches):
            h, tail, first = tokens(batch.column(0))
            number = m.vocabulary.find(h)
            m.learn(m.features(h, tail, number, first), m.classes(number), seen)
        if seen.any():
            yield blocks(m.weights * seen[:, None], seen, TaskContext.get().partitionId())

    def blocks(total, seen, part):
        total, seen = total.astype(np.float32).reshape(n_blocks, -1), seen.reshape(n_blocks, -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(n_blocks), pa.int32()), pa.array([part % 32] * n_blocks, pa.int32()),
             pa.array([x.tobytes() for x in seen], pa.binary()), pa.array([x.tobytes() for x in total], pa.binary())],
            ["block", "part", "seen", "total"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for block, seen, total in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                got = sums.setdefault(block, [np.zeros(BLOCK, np.int64), np.zeros(BLOCK * CLASSES, np.float64)])
                got[0] += np.frombuffer(seen, np.int64)
                got[1] += np.frombuffer(total, np.float32)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums, pa.int32()), pa.array([0] * len(sums), pa.int32()),
                 pa.array([x[0].tobytes() for x in sums.values()], pa.binary()),
                 pa.array([x[1].astype(np.float32).tobytes() for x in sums.values()], pa.binary())],
                ["block", "part", "seen", "total"])

    kind = "block int, part int, seen binary, total binary"
    parts = spread_rows(train.select("text")).mapInArrow(run, kind)
    parts = parts.repartition("block", "part").mapInArrow(add, kind).repartition("block").mapInArrow(add, kind)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for row in parts.collect():  # ROWS * CLASSES numbers in all
        seen = np.frombuffer(row["seen"], np.int64)
        total = np.frombuffer(row["total"], np.float32).reshape(BLOCK, CLASSES)
        weights[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = total / np.maximum(seen, 1)[:, None]
    return weights


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Base and model score of every row of ``docs`` (``doc_id``, ``held_out``, ``text``), learning from ``train``."""
    counts = cut_lineage(count_words(train))
    model = start_model(counts)
    model.weights = train_weights(train, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: MAX_TOP words and the weight table

    def run(batches):
        m: Model = shared.value
        serial = TaskContext.get().partitionId() << 40
        for batch in T.slices(batches):
            h, tail, first = tokens(batch.column(2))
            n = batch.num_rows
            number = m.vocabulary.find(h)
            gain = np.add.reduceat(m.gains(m.features(h, tail, number, first), m.classes(number)), first[:-1])
            hit = number >= 0
            value = np.zeros(len(h))
            value[hit] = np.log10((m.counts[number[hit]] + 0.5) / m.mass)
            rare = np.flatnonzero(~hit)
            doc = np.repeat(np.arange(n), np.diff(first))
            # distinct rare words of each text, for the join with the count table
            order = rare[np.lexsort((h[rare], doc[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            at = np.flatnonzero(new)
            each = np.diff(np.append(at, len(order)))
            per_doc = np.bincount(doc[order[at]], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [T.int_array(serial + np.arange(n)), batch.column(0), batch.column(1), T.int_array(np.diff(first)),
                 T.int_array(np.add.reduceat(hit.astype(np.int64), first[:-1])),
                 pa.array(np.add.reduceat(value, first[:-1])), pa.array(gain),
                 T.lists(h[order[at]].view(np.int64), per_doc), T.lists(each, per_doc)],
                ["_row", "doc_id", "held_out", "n_tokens", "_known", "_base", "_gain", "_rare", "_times"])
            serial += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = cut_lineage(spread_rows(docs.select("doc_id", "held_out", "text")).mapInArrow(
        run, f"_row long, doc_id {kind}, held_out boolean, n_tokens long, _known long, _base double, _gain double, "
             "_rare array<long>, _times array<long>"))
    rare = (scored.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("w"))
            .select("_row", F.col("w._rare").alias("h"), F.col("w._times").alias("times")))
    mass = F.lit(float(model.mass))
    rare = (rare.join(counts, "h", "left").groupBy("_row")
            .agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / mass)).alias("_rest"),
                 F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_found")))
    base = F.col("_base") + F.coalesce("_rest", F.lit(0.0))
    return (scored.drop("_rare", "_times").join(rare, "_row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("_known") + F.coalesce("_found", F.lit(0))).alias("n_known"),
                    F.lit(int(model.n_tokens)).cast("long").alias("train_tokens"),
                    base.alias("base_score"), (base + F.col("_gain")).alias("score")))


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    return score(docs, docs.where(~F.col("held_out")))
