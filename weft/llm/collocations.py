"""Phrase collocations from weighted acyclic automata over word windows.

1. Shard automata. From every word a window of up to five words runs to the end of its piece. A shard's
   windows (``SHARD`` bytes of text) are sorted, and the automaton that reads them grows by each window's
   words beyond those it shares with the window before. A window's weight is its number of
   occurrences; the weights below a state add up to the occurrences of the phrase that leads there.
2. Prefix ranges. Splitters from a sample of windows, as many per range whatever their number, cut the sorted
   order into ranges of about ``RANGE`` bytes of text. A shard sends each range its part of the automaton.
3. Union. A range's automata are merged and equal windows' weights added. All phrases of ``min_count``
   occurrences are read off; those on a range's first and last path may go on in the next range
   and are added up by Spark.
4. Part lookups. The frequent phrases of a range form an automaton again. The first and last words of all
   candidates, sorted, are composed with it: all lookups of a task walk its arcs together, word by word.

Words are numbered by their bytes, so nothing depends on a hash. A passage that many documents share
is one window per shard; a word or pair that starts a third of all windows is cut by the splitters,
which are whole windows. Lookups of one part by very many candidates are dealt out in lots.

Words have A-Z lower-cased. Defined results: a null text has no words, a null language is ``und``; repeated
rows and rows with equal or null ids all count; equal scores are ranked by count and then by the phrase's
bytes; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import spans
from weft.llm import text as T
from weft.llm.registry import query
from weft.session import cut_lineage, spread_rows
from weft.sources.files import read_table

WORDS = 5          # of a phrase
MIN_COUNT = 100
TOP = 2000
CONTAINED = 100    # a phrase goes if a longer one has this many hundredths of its occurrences
SHARD = 1 << 23
RANGE = 1 << 23
SAMPLE = 64        # sampled windows per range
LOT = 1 << 16      # lookups of a range in one task
SEPARATOR = spans.byte_set([*b".,;:!?", *range(0x0A, 0x0E)])
WORD = ~(SEPARATOR | spans.byte_set(b" \t"))


class Automaton:
    """Acyclic automaton over rows of word numbers (0 ends a row). ``arcs[k]`` has the sorted arcs
    ``state << 32 | number`` of depth ``k``; an arc's place is the state it leads to. ``weights[k]`` are the
    weights of the rows that end in the states of depth ``k + 1``."""

    def __init__(self, rows: np.ndarray, weights: np.ndarray):
        self.arcs, self.weights = [], []
        state = np.zeros(len(rows), np.int64)
        for k in range(rows.shape[1]):
            go = rows[:, k] > 0
            rows, weights, state = rows[go], weights[go], state[go]
            arcs, state = np.unique(state << 32 | rows[:, k], return_inverse=True)
            ends = rows[:, k + 1] == 0 if k + 1 < rows.shape[1] else np.ones(len(rows), bool)
            self.arcs.append(arcs)
            self.weights.append(np.bincount(state[ends], weights[ends], len(arcs)).astype(np.int64))

    def compose(self, rows: np.ndarray) -> np.ndarray:
        """Weight of each row; 0 if the automaton does not accept it."""
        out = np.zeros(len(rows), np.int64)
        at, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for k, (arcs, weights) in enumerate(zip(self.arcs, self.weights)):
            key = state << 32 | rows[at, k]
            place = np.searchsorted(arcs, key)
            found = place < len(arcs)
            found[found] = arcs[place[found]] == key[found]
            at, state = at[found], place[found]
            ends = rows[at, k + 1] == 0 if k + 1 < rows.shape[1] else np.ones(len(at), bool)
            out[at[ends]] = weights[state[ends]]
            at, state = at[~ends], state[~ends]
        return out


def _packed(rows: np.ndarray) -> list[np.ndarray]:
    """Few 64-bit columns that compare as the rows of numbers do."""
    bits = max(1, int(rows.max(initial=0)).bit_length())
    per = 63 // bits
    out = []
    for a in range(0, rows.shape[1], per):
        key = np.zeros(len(rows), np.int64)
        for column in rows.T[a:a + per]:
            key = key << bits | column
        out.append(key)
    return out


def _merged(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows with the sums of their weights."""
    order, head = spans.groups(*_packed(rows))
    return rows[order[head]], np.add.reduceat(weights[order], head) if len(head) else weights


def _shared(rows: np.ndarray) -> np.ndarray:
    """How many leading numbers each sorted row has in common with the row before (the first: none)."""
    same = np.zeros(rows.shape, bool)
    same[1:] = rows[1:] == rows[:-1]
    return np.logical_and.accumulate(same, 1).sum(1)


def _windows(batch: pa.RecordBatch, splitters: list[tuple]):
    """Rows (language, words...) of numbers of a slice, sorted and distinct, their weights, the languages and words
    by number, and where each splitter stands among the rows. Number 0 is the end of a piece."""
    data, offsets = T.utf8(batch.column(1))
    lang, langs = spans.numbered(pa.concat_arrays([batch.column(0).cast(pa.large_string()),
                                                   pa.array([s[0] for s in splitters], pa.large_string())]))
    start, end, doc = spans.runs(data, offsets, WORD)
    texts = spans.strings(T.LOWER[data], start, end)
    extra = pa.array([w for s in splitters for w in s[1:]], pa.large_string())
    number, words = spans.numbered(pa.concat_arrays([texts, extra]))
    word, number = number[:len(start)] + 1, (number[len(start):] + 1).tolist()
    piece = np.cumsum(SEPARATOR[data])[start] if len(start) else start
    last = np.ones(len(start), bool)
    last[:-1] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    stop = np.flatnonzero(last)
    left = stop[np.searchsorted(stop, np.arange(len(start)))] - np.arange(len(start)) if len(start) else start
    rows = np.zeros((len(start), WORDS + 1), np.int64)
    rows[:, 0] = lang[doc]
    for k in range(WORDS):
        rows[:len(start) - k, k + 1] = np.where(left[:len(start) - k] >= k, word[k:], 0)
    marks = np.zeros((len(splitters), WORDS + 1), np.int64)
    marks[:, 0] = lang[batch.num_rows:]
    for mark, split in zip(marks, splitters):
        mark[1:len(split)], number = number[:len(split) - 1], number[len(split) - 1:]
    both = _packed(np.concatenate([rows, marks]))
    order, head = spans.groups(*[key[:len(rows)] for key in both])
    weights = np.diff(np.append(head, len(order)))
    keys = [key[order[head]] for key in both]
    places = []
    for mark in zip(*[key[len(rows):].tolist() for key in both]):
        low, high = 0, len(head)
        for key, value in zip(keys, mark):
            part = key[low:high]
            low, high = low + int(np.searchsorted(part, value)), low + int(np.searchsorted(part, value, "right"))
        places.append(low)
    return rows[order[head]], weights, langs, words, places


def _texts(docs: DataFrame) -> DataFrame:
    return spread_rows(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                                   F.col("text").cast("string").alias("text")))


def _splitters(docs: DataFrame, range_bytes: int) -> list[tuple]:
    """Sorted windows ``(lang, words...)`` that cut the windows into ranges of about ``range_bytes`` of text."""
    texts = _texts(docs)
    size, n = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = -(-(size or 0) // range_bytes)
    if ranges < 2:
        return []
    want = SAMPLE * ranges
    share = min(1.0, 4 * want / n)             # of the documents
    step = max(1, int(size / 6 * share / want))  # of their windows, one in so many

    def run(batches):
        rng = np.random.default_rng(0)
        for batch in T.slices(batches, max_bytes=1 << 20):
            data, offsets = T.utf8(batch.column(1))
            start, end, doc = spans.runs(data, offsets, WORD)
            piece = np.cumsum(SEPARATOR[data])[start] if len(start) else start
            rows = []
            for i in np.flatnonzero(rng.random(len(start)) * step < 1).tolist():
                same = [j for j in range(i, min(i + WORDS, len(start))) if doc[j] == doc[i] and piece[j] == piece[i]]
                rows.append((batch.column(0)[int(doc[i])].as_py(),
                             [T.LOWER[data[start[j]:end[j]]].tobytes().decode() for j in same]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["lang", "words"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = cut_lineage(some.mapInArrow(run, "lang string, words array<string>"))
    # At most a few times SAMPLE rows per range meet in this window; the driver gets one row per range.
    place = F.ntile(int(ranges)).over(Window.orderBy("lang", "words"))
    first = got.withColumn("range", place).groupBy("range").agg(F.min(F.struct("lang", "words")).alias("w"))
    found = {(r.w.lang, *r.w.words) for r in first.where("range > 1").collect()}
    return sorted(found, key=_order)


def _order(window) -> list[bytes]:
    return [w.encode() for w in window]


BLOCK = "range int, block binary"
_PARTS = pa.schema([("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("shared", pa.binary()),
                    ("numbers", pa.binary()), ("weights", pa.binary())])


def shard_automata(docs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """A row per shard and range: the sorted windows as numbers beyond those shared with the window before."""
    def run(batches):
        for batch in T.slices(batches, max_bytes=SHARD, max_rows=1 << 20):
            rows, weights, langs, words, places = _windows(batch, splitters)
            cuts = [0, *places, len(rows)]
            found = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            for k, a, b in found:
                yield _block(k, rows[a:b], weights[a:b], langs, words)

    return _texts(docs).mapInArrow(run, BLOCK)


def _block(k: int, rows: np.ndarray, weights: np.ndarray, langs: pa.Array, words: pa.Array) -> pa.RecordBatch:
    shared = _shared(rows)
    new = np.arange(WORDS + 1) >= shared[:, None]
    lang, rows[:, 0] = np.unique(rows[:, 0], return_inverse=True)
    some, number = np.unique(np.append(rows[:, 1:].ravel(), 0), return_inverse=True)  # 0 stays the end
    rows[:, 1:] = number[:-1].reshape(len(rows), WORDS)
    parts = pa.RecordBatch.from_arrays(
        [_list(langs.take(pa.array(lang)).cast(pa.string())), _list(words.take(pa.array(some[1:] - 1)).cast(pa.string())),
         pa.array([shared.astype(np.uint8).tobytes()]), pa.array([_planes(rows[new])]), pa.array([_planes(weights)])], schema=_PARTS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PARTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(parts)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()])],
                                      ["range", "block"])


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all their lowest bytes first and so on: the upper ones are mostly zero and pack well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: pa.Scalar) -> np.ndarray:
    return np.frombuffer(planes.as_py(), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64)


def _parts(block: bytes) -> dict:
    batch = pa.ipc.open_stream(block).read_next_batch()
    return {name: batch.column(name)[0] for name in _PARTS.names}


def _rows(block: dict) -> np.ndarray:
    """The sorted windows of a block."""
    shared = np.frombuffer(block["shared"].as_py(), np.uint8)
    new = np.arange(WORDS + 1) >= shared[:, None]
    rows = np.zeros(new.shape, np.int64)
    rows[new] = _numbers(block["numbers"])
    for k in range(WORDS + 1):  # a number that is not new is that of the last row that has its own
        source = np.maximum.accumulate(np.where(new[:, k], np.arange(len(rows)), 0))
        rows[:, k] = rows[source, k]
    return rows


def _union(blocks: list[dict]):
    """Windows, weights, languages and words of several blocks."""
    rows = [_rows(b) for b in blocks]
    lang, langs = spans.numbered(pa.concat_arrays([b["langs"].values for b in blocks]).cast(pa.large_string()))
    word, words = spans.numbered(pa.concat_arrays([b["words"].values for b in blocks]).cast(pa.large_string()))
    at, of = 0, 0
    for r, b in zip(rows, blocks):
        r[:, 0] = lang[at:at + len(b["langs"].values)][r[:, 0]]
        r[:, 1:] = np.append(0, word[of:of + len(b["words"].values)] + 1)[r[:, 1:]]
        at, of = at + len(b["langs"].values), of + len(b["words"].values)
    weights = np.concatenate([_numbers(b["weights"]) for b in blocks])
    return *_merged(np.concatenate(rows), weights), langs, words


def phrase_counts(docs: DataFrame, splitters: list[tuple], min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f): all phrases of ``min_count`` occurrences or more, and per language a row with a
    null phrase and the number of its word occurrences."""
    def run(batches):
        held = [_parts(block) for batch in batches for block in batch.column(0).to_pylist()]
        if held:
            yield from _frequent(*_union(held), min_count)

    # A range is a partition, by its number.
    blocks = shard_automata(docs, splitters).repartitionById(len(splitters) + 1, F.col("range"))
    counts = blocks.select("block").mapInArrow(run, "lang string, phrase string, words int, f long")
    return counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(
        (F.col("f") >= min_count) | F.col("phrase").isNull())


def _frequent(rows, weights, langs, words, min_count: int):
    below = np.append(0, np.cumsum(weights))
    shared = _shared(rows)
    for k in range(WORDS + 1):  # states of depth k: the phrases of k words
        head = np.flatnonzero(shared <= k)
        total = np.diff(np.append(below[head], below[-1]))
        some = (rows[head, k] > 0) & (total >= min_count) if k else np.ones(len(head), bool)
        if k and len(head):  # paths that the neighbouring ranges may share
            some[[0, -1]] = rows[head[[0, -1]], k] > 0
        head, total = head[some], total[some]
        phrase = [words.take(pa.array(rows[head, j] - 1)).cast(pa.string()) for j in range(1, k + 1)]
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(rows[head, 0])).cast(pa.string()),
             pc.binary_join_element_wise(*phrase, " ") if k else pa.nulls(len(head), pa.string()),
             pa.array(np.full(len(head), k, np.int32)), pa.array(total)], ["lang", "phrase", "words", "f"])


def part_counts(phrases: DataFrame, parts: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``parts`` (lang, part, ...) with ``f``, the count of ``part`` among the frequent phrases."""
    keys = [_order(s) for s in splitters]

    def place(column: str):
        def run(batches):
            for batch in batches:
                windows = zip(batch.column("lang").to_pylist(), batch.column(column).to_pylist())
                at = [bisect.bisect_right(keys, _order((lang, *words.split(" ")))) for lang, words in windows]
                yield batch.append_column("range", pa.array(at, pa.int32()))
        return run

    def placed(frame: DataFrame, column: str) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        return frame.mapInArrow(place(column), f"{fields}, range int")

    asked = placed(parts, "part").withColumn("_row", F.xxhash64("*"))
    lots = asked.groupBy("range").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))  # one row per range
    asked = asked.join(lots, "range").withColumn("lot", F.pmod("_row", "lots").cast("int")).drop("lots", "_row")
    known = placed(phrases.select("lang", "phrase", "f"), "phrase").join(lots, "range").withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")

    def look(known: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.drop_columns(["range", "lot"])
        rows = _phrase_rows(pa.concat_arrays([*known.column("phrase").chunks, *asked.column("part").chunks]),
                            pa.concat_arrays([*known.column("lang").chunks, *asked.column("lang").chunks]))
        automaton = Automaton(*_merged(rows[:len(known)], known.column("f").to_numpy()))
        return asked.append_column("f", pa.array(automaton.compose(rows[len(known):])))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return known.groupBy("range", "lot").cogroup(asked.groupBy("range", "lot")).applyInArrow(look, f"{fields}, f long")


def _phrase_rows(phrases: pa.Array, lang: pa.Array) -> np.ndarray:
    """(language, words...) numbers, all from 1, 0 after the end."""
    split = pc.split_pattern(phrases, " ")
    number, _ = spans.numbered(split.flatten().cast(pa.large_string()))
    sizes = pc.list_value_length(split).to_numpy()
    rows = np.zeros((len(phrases), WORDS + 1), np.int64)
    rows[:, 0] = spans.numbered(lang.cast(pa.large_string()))[0] + 1
    text = np.repeat(np.arange(len(phrases)), sizes)
    rows[text, np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = number + 1
    return rows


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED,
                 range_bytes: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations."""
    splitters = _splitters(docs, range_bytes)
    counts = cut_lineage(phrase_counts(docs, splitters, min_count))
    phrases = counts.where("phrase is not null")
    candidates = phrases.where("words > 1")
    sizes = counts.where("phrase is null").select("lang", F.col("f").alias("n"))  # one row per language

    word = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("_w", word)
    sides = cut.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit("r").alias("side"), F.array_join(F.slice("_w", F.col("k") + 1, F.lit(WORDS)), " ").alias("part")),
    )).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    found = part_counts(phrases, sides, splitters).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr("cast(1000 as decimal(38,0)) * a * n div (cast(l as decimal(38,0)) * r)")
    lots = F.sequence(F.lit(0), F.lit(15))  # a language's phrases meet its size in several tasks
    sizes = sizes.withColumn("_lot", F.explode(lots))
    found = found.withColumn("_lot", F.pmod(F.xxhash64("phrase"), F.lit(16)).cast("int"))
    best = found.join(sizes, ["lang", "_lot"]).withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b"))

    inner = candidates.where("words > 2").withColumn("_w", word).withColumn(
        "_n", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn(
        "_at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_n") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice("_w", F.col("_at"), F.col("_n")), " ").alias("phrase")).agg(
        F.max("f").alias("longer"))
    best = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "b.l", "b.r", "n", "b.score")


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
s AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {WORDS + 1}) AS r(k)) GROUP BY ALL
  HAVING count(*) >= {MIN_COUNT}
), c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM c),
x AS (
  SELECT u.lang, u.phrase, u.a, s.n, cut, p1.f AS l, p2.f AS r,
    (1000::HUGEINT * u.a * s.n) // (p1.f::HUGEINT * p2.f) AS score
  FROM u JOIN s ON u.lang = s.lang JOIN f AS p1 ON p1.lang = u.lang AND p1.phrase = array_to_string(w[1:cut], ' ')
  JOIN f AS p2 ON p2.lang = u.lang AND p2.phrase = array_to_string(w[cut + 1:], ' ')
), b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS i
        FROM (SELECT lang, a, w, k, unnest(range(2, k)) AS size FROM c)) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a,
  l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase
WHERE longer IS NULL OR 100 * longer < {CONTAINED} * a
QUALIFY rank <= {TOP}
"""


@query("op13_collocations", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
