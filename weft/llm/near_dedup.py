"""Near-duplicate documents: banded MinHash candidates, odd sketches, exact links.

A document's set is its distinct 5-word shingles. Documents with equal sets form
a class, represented by its smallest id; only representatives are compared.

1. MinHash samples are grouped into bands; representatives that agree on a band
   share a bucket. With 32 bands of 4, a pair at the threshold shares none with
   probability 6e-6.
2. A second MinHash sample (one minimum per bin of one permutation) is folded into
   a parity bitmap. The population count of two bitmaps' XOR estimates how many
   samples differ, the occupied bins how many there are, and so the similarity to
   about 0.015. Inside a bucket, pairs estimated below ``THRESHOLD - SLACK`` are
   not candidates. Large buckets are compared block by block.
3. Candidates are joined into clusters: a bucket gives a star for each of its
   connected groups, so a group of any size costs a row per member and bucket.
4. Inside a cluster (again block by block when it is large) candidates are confirmed
   on the full sets of the whole texts. A document that has joined a component is
   compared only with those that have not; every candidate between two
   components is checked.

Defined results: null and empty texts, and texts without words, have an empty set
and are linked with nothing; fewer than five words make one shingle; rows with a
null id are not linked, have a null component and are kept; rows that repeat an id
are judged by their own texts; an empty table gives an empty table; other
columns are not read by :func:`near_duplicates` and pass through :func:`dedup`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import text as T
from weft.llm.graph import components
from weft.llm.registry import query
from weft.session import cut_lineage, spread_rows
from weft.sources.files import read_table

SHINGLE = 5
THRESHOLD = 75              # per cent of the union that two sets must share
BANDS, BAND_ROWS = 32, 4
BINS = 1024                 # MinHash samples of a sketch
BITS = 2048                 # parity bits they are folded into
SLACK = 0.07                # over four standard errors of the estimate
SMALL = 64                  # rows of a bucket whose pairs are all looked at
BLOCK = 2048                # rows of a bucket or cluster compared at once
BLOCK_BYTES = 16 << 20      # and the text of a cluster's rows held at once
_SEEDS = T.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_MARK = T.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 << 20))


def sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within a text, and the texts' boundaries."""
    data, offsets = T.utf8(column)
    words = T.Words(T.LOWER[data], offsets)
    h = words.hashes()
    shingle, at = T.shingles(h, words.first, SHINGLE)
    owner = np.searchsorted(words.first, at, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    whole = np.zeros(len(short), np.uint64)  # the whole sequence of a short text, told apart by its length
    for k in range(SHINGLE - 1):
        has = words.counts[short] > k
        whole[has] = whole[has] * np.uint64(0xD6E8FEB86659FD93) + h[words.first[short][has] + k]
    whole = T.mix(whole + words.counts[short].astype(np.uint64))
    shingle, owner = np.concatenate([shingle, whole]), np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    return shingle, np.searchsorted(owner, np.arange(len(column) + 1))


def _digest(text: str):
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: the text's digest, set size, a 128-bit hash of the set, the band keys and the odd sketch."""
    def run(batches):
        for batch in T.slices(batches):
            shingle, first = sets(batch.column(1))
            n = batch.num_rows
            size = np.diff(first)
            some = np.flatnonzero(size)
            begin = first[:-1][some]
            bands = np.zeros((len(some), BANDS), np.uint64)
            low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            odd, used = np.zeros((n, BITS // 8), np.uint8), np.zeros((n, BINS // 8), np.uint8)
            if len(some):
                for k, seed in enumerate(_SEEDS):
                    least = np.minimum.reduceat(shingle * seed, begin)
                    bands[:, k // BAND_ROWS] = T.mix(bands[:, k // BAND_ROWS] * np.uint64(31) + least)
                bands = T.mix(bands + _MARK)
                low[some] = np.add.reduceat(T.mix(shingle ^ np.uint64(0xA5A5)), begin)
                high[some] = np.add.reduceat(T.mix(shingle + np.uint64(0x5A5A5A5A)), begin)
                odd[some], used[some] = sketches(shingle, np.repeat(np.arange(len(some)), size[some]), len(some))
            counts = np.zeros(n, np.int64)
            counts[some] = BANDS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), T.int_array(size.astype(np.int64)), T.int_array(low.view(np.int64)),
                 T.int_array(high.view(np.int64)), T.lists(bands.reshape(-1).view(np.int64), counts),
                 pa.array([x.tobytes() for x in odd], pa.binary()),
                 pa.array([x.tobytes() for x in used], pa.binary())],
                ["doc_id", "digest", "n_shingles", "low", "high", "bands", "odd", "used"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread_rows(docs.select("doc_id", "text", _digest("text").alias("digest"))).mapInArrow(
        run, f"doc_id {kind}, digest string, n_shingles long, low long, high long, bands array<long>, odd binary, used binary")


def sketches(shingle: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmap of each set's samples (the least hash of every bin) and its occupied bins."""
    h = T.mix(shingle ^ np.uint64(0x0DD))
    cell = owner * BINS + (h >> np.uint64(54)).astype(np.int64)  # BINS == 1 << 10
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, cell, h)
    taken = np.zeros(n * BINS, bool)
    taken[cell] = True
    at = np.flatnonzero(taken)
    bit = (at // BINS) * BITS + (T.mix(least[at]) & np.uint64(BITS - 1)).astype(np.int64)
    parity = np.bincount(bit, minlength=n * BITS) & 1
    return (np.packbits(parity.astype(bool).reshape(n, BITS), axis=1),
            np.packbits(taken.reshape(n, BINS), axis=1))


def estimate(odd_a, odd_b, used_a, used_b) -> np.ndarray:
    """Similarity from bitmaps given as uint64 words along the last axis."""
    differ = np.bitwise_count(odd_a ^ odd_b).sum(-1, dtype=np.int64)
    differ = -BITS / 2 * np.log1p(-2 * np.minimum(differ, BITS / 2 - 1) / BITS)
    samples = np.bitwise_count(used_a).sum(-1, dtype=np.int64) + np.bitwise_count(used_b).sum(-1, dtype=np.int64)
    union = np.bitwise_count(used_a | used_b).sum(-1, dtype=np.int64)
    return (samples - differ) / 2 / np.maximum(union, 1)


def _near(odd: np.ndarray, used: np.ndarray, i, j) -> np.ndarray:
    """Which rows ``i`` and ``j`` are candidates."""
    return estimate(odd[i], odd[j], used[i], used[j]) >= THRESHOLD / 100 - SLACK


def _grown(n: int, near) -> list[tuple[int, int]]:
    """Pairs that connect all of ``n`` rows that ``near(row, others)`` connects; it returns those of the
    ``others`` that are. A group grows from one row; a row that has joined is compared only with
    rows that have not, so a tight group costs a comparison per member."""
    out, free = [], np.arange(n)
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            row = queue.pop()
            joined = near(row, free)
            if len(joined):
                out += [(row, int(x)) for x in joined]
                queue += joined.tolist()
                free = np.setdiff1d(free, joined, assume_unique=True)
    return out


def _small_pairs(group: np.ndarray, size: np.ndarray, odd: np.ndarray, used: np.ndarray):
    """Candidate pairs (i, j) inside runs of equal ``group`` of at most ``SMALL`` rows, for all runs at once."""
    small, found = np.repeat(size <= SMALL, size), [(np.zeros(0, np.int64),) * 2]
    for step in range(1, min(SMALL, size.max(initial=0))):
        at = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        at = at[_near(odd, used, at, at + step)]
        found.append((at, at + step))
    return (np.concatenate(x) for x in zip(*found))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row connected to each of ``n`` rows by the pairs."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _whole(batches, keys: int):
    """Batches that hold all rows of the groups they touch, from rows sorted by the first ``keys`` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        values = [held.column(k).to_numpy() for k in range(keys)]
        other = np.flatnonzero(np.any([v != v[-1] for v in values], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _bitmaps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _dealt(rows: DataFrame, key: str, blocks) -> DataFrame:
    """Rows dealt by ``key`` and ``part``. A key of several blocks has a part for every two of its
    blocks, and a row is in the parts of its own block."""
    mine = F.pmod(F.xxhash64("rep"), F.col("_g")).cast("int")
    other = F.explode(F.when(F.col("_g") == 1, F.array(F.lit(0)))
                      .otherwise(F.filter(F.sequence(F.lit(0), F.col("_g") - 1), lambda x: x != F.col("_b"))))
    part = (F.least("_b", "_o") * F.col("_g") + F.greatest("_b", "_o")).alias("part")
    return (rows.withColumn("_g", blocks.cast("int")).withColumn("_b", mine).withColumn("_o", other)
            .withColumn("part", part).drop("_g", "_b", "_o").repartition(key, "part")
            .sortWithinPartitions(key, "part", "rep"))


def clusters(buckets: DataFrame, sketch: DataFrame) -> DataFrame:
    """(rep, cluster): the connected groups of candidate pairs, from ``(key, rep)`` and ``(rep, odd, used)``."""
    def run(batches):
        for rows in _whole(batches, 2):
            key, part, rep = (rows.column(k).to_numpy() for k in range(3))
            group = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            odd, used = _bitmaps(rows.column(3)), _bitmaps(rows.column(4))
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(cuts, len(group)))
            root = _roots(len(rep), *_small_pairs(group, size, odd, used))
            at = np.flatnonzero(root != np.arange(len(root)))
            u, v = [rep[at]], [rep[root[at]]]
            for a, n in zip(cuts[size > SMALL], size[size > SMALL]):
                pairs = _grown(n, lambda i, j, a=a: j[_near(odd, used, a + i, a + j)])
                if pairs:
                    i, j = np.array(pairs).T
                    u.append(rep[a + i])
                    v.append(rep[a + j])
            yield pa.RecordBatch.from_arrays([T.int_array(np.concatenate(u)), T.int_array(np.concatenate(v))], ["u", "v"])

    sizes = buckets.groupBy("key").agg(F.count("*").alias("_m"))
    rows = buckets.join(sizes, "key").join(sketch, "rep")
    rows = _dealt(rows, "key", F.ceil(F.col("_m") / BLOCK)).select("key", "part", "rep", "odd", "used")
    return components(rows.mapInArrow(run, "u long, v long")).select(
        F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _linked(rep: np.ndarray, odd: np.ndarray, used: np.ndarray, text) -> list[tuple[int, int]]:
    """Confirmed links that connect all that is linked among the rows: at most one less than rows."""
    shingle, first = sets(text)

    def near(row, others):
        mine = shingle[first[row]:first[row + 1]]
        joined = []
        for other in others[_near(odd, used, row, others)].tolist():
            theirs = shingle[first[other]:first[other + 1]]
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if both and 100 * both >= THRESHOLD * (len(mine) + len(theirs) - both):
                joined.append(other)
        return np.array(joined, np.int64)

    return [(int(rep[i]), int(rep[j])) for i, j in _grown(len(rep), near)]


def links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links ``(u, v)`` inside the clusters, from ``(rep, cluster, odd, used)`` and the whole texts."""
    def run(batches):
        for rows in _whole(batches, 2):
            key, part, rep = (rows.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            odd, used, out = _bitmaps(rows.column(3)), _bitmaps(rows.column(4)), []
            for a, b in zip(cuts, np.append(cuts[1:], len(key))):
                out += _linked(rep[a:b], odd[a:b], used[a:b], rows.column(5).slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])

    rows = docs.join(members, docs["doc_id"] == members["rep"]).select("cluster", "rep", "odd", "used", "text")
    rows = cut_lineage(rows)
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("_m"), F.sum(F.octet_length("text")).alias("_n"))
    blocks = F.greatest(F.ceil(F.col("_m") / BLOCK), F.ceil(F.col("_n") / BLOCK_BYTES))
    return (_dealt(rows.join(sizes, "cluster"), "cluster", blocks)
            .select("cluster", "part", "rep", "odd", "used", "text").mapInArrow(run, "u long, v long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    return _judged(docs).drop("digest")


def _judged(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut_lineage(signatures(docs))
    one_set = ["n_shingles", "low", "high"]
    reps = cut_lineage(
        signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*one_set)
        .agg(F.min_by(F.struct("doc_id", "bands", "odd", "used"), "doc_id").alias("r"))
        .select(*one_set, F.col("r.doc_id").alias("rep"), "r.bands", "r.odd", "r.used"))

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = cut_lineage(keyed.join(shared, "key"))
    sketch = reps.select("rep", "odd", "used")

    members = clusters(buckets, sketch).join(sketch, "rep")
    groups = components(links(members, docs)).withColumnRenamed("node", "rep")

    out = signed.select("doc_id", "digest", *one_set).join(reps.select(*one_set, "rep"), one_set, "left").join(groups, "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "digest", "n_shingles",
                      own.cast(kind).alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component. A row is known by its id and its
    text: of rows that repeat an id, those go whose own text has a smaller document; rows that repeat both are
    one document and stay or go together."""
    gone = _judged(docs).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_gone_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (_digest("text") == gone["_gone_text"]), "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM e JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
), b AS (
  SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.doc_id
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query("op8_near_dedup", ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
