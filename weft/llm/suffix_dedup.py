"""Exact substring dedup over a sparse, range-partitioned suffix array.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a
smaller id is removed. Not every suffix is shipped:

* Anchors. A window of ``LENGTH`` bytes selects the smallest ``GRAM``-byte gram in it (by
  hash, the first on ties). Equal windows select the same place, so it is enough to
  sort the suffixes that begin at selected places, each with the windows that
  selected it.
* Pruning. First only 32-bit hashes of the anchors' grams travel: suffixes whose gram
  occurs in one slice of rows and there in one document have no equal elsewhere.
* Range partitioning. Splitters sampled from the anchors' leading bytes deal the rest
  into buckets. Equal grams share a bucket, so suffixes on two sides of a border
  differ within their leading bytes and the comparison across borders is settled
  by the splitter itself.
* Sorting. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time,
  descending only into runs that are still equal. Runs of equal suffixes are resolved
  to their smallest document; suffixes that share the gram but not all windows
  are cut into single windows and sorted the same way, one gram and offset at a time.
* Hot passages. A task first resolves equal suffixes among the rows it sees, so a
  passage in a third of all documents sends one suffix per slice of rows.

The texts are dealt to shards of documents once; that exchange serves pruning, shipping
and the removal. What the buckets tell a shard (shared hashes, byte ranges) travels as a
packed row per bucket and shard.

Defined results: null and empty texts have 0 bytes; a null id takes no part and loses
nothing; rows that repeat an id are compared with smaller ids only, never with
each other; texts shorter than ``LENGTH`` bytes lose nothing; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import text as T
from weft.llm.registry import query
from weft.session import spread_rows
from weft.sources.files import read_table

LENGTH = 50
GRAM = 20
GRAMS = LENGTH - GRAM + 1      # grams in a window
BUCKET_BYTES = 16 << 20        # text behind one bucket of suffixes
HASH_BYTES = 32 << 20          # and behind one bucket of hashes
SAMPLE_ROWS = 2000             # texts whose anchors give the splitters
CHUNK = 1 << 18                # windows sorted at once
SLICE_BYTES = 1 << 20          # text whose anchors are found at once
SHARD_BYTES = 4 << 20          # text of the documents handled together
_MAX = np.iinfo(np.uint64).max


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over [i, i + width) for every i; values past the end are left out."""
    out, spare, span = values.copy(), np.empty_like(values), 1
    while span < width:
        step = min(span, width - span, len(out))
        op(out[:len(out) - step], out[step:], out=spare[:len(out) - step])
        spare[len(out) - step:] = out[len(out) - step:]
        out, spare = spare, out
        span += step or width
    return out


class Anchors:
    """Selected places of a slice of texts: ``place`` (byte), ``first``/``last`` window start that selects it,
    ``doc`` (row) and the gram's hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray | bool = True):
        n = len(data)
        starts = np.zeros(0, np.int64)
        long_ = np.flatnonzero((np.diff(offsets) >= LENGTH) & known)
        self.place = self.first = self.last = self.doc = starts
        self.hash = np.zeros(0, np.uint64)
        self.acc = None
        if not len(long_):
            return
        self.acc = acc = T.prefix(data)
        gram = T.mix((acc[GRAM:] - acc[:-GRAM]) * T.powers(n + 1)[1][:n - GRAM + 1])
        least = _sliding(gram, GRAMS, np.minimum)
        # a gram is a minimum if some window that holds it has it as its least
        back = _sliding(least[::-1], GRAMS, np.maximum)[::-1]
        is_min = back == gram
        place = np.flatnonzero(is_min)
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, offsets[:-1][long_], 1)
        np.add.at(inside, offsets[1:][long_] - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        index = (np.cumsum(is_min, dtype=np.int64) - is_min)[starts]
        want = least[starts]
        todo = np.flatnonzero(gram[place[index]] != want)
        while len(todo):
            index[todo] += 1
            todo = todo[gram[place[index[todo]]] != want[todo]]
        new = np.ones(len(starts), bool)
        new[1:] = (index[1:] != index[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        self.place = place[index[at]]
        self.first = starts[at]
        self.last = starts[np.append(at[1:], len(starts)) - 1]
        self.doc = np.searchsorted(offsets, self.first, "right") - 1
        self.hash = gram[self.place]


def _leading(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts like them."""
    return np.ascontiguousarray(data[place[:, None] + np.arange(8)]).view(">u8").reshape(-1).astype(np.uint64)


def multikey_sort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by several keys, and the number of each sorted row's run of equal rows.

    Each key (eight bytes of text) is looked at only inside runs the earlier keys leave equal."""
    n = len(columns[0])
    order = np.argsort(columns[0], kind="stable")
    first = columns[0][order]
    head = np.ones(n, bool)
    head[1:] = first[1:] != first[:-1]
    for column in columns[1:]:
        alone = head & np.append(head[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            break
        run = np.cumsum(head)[rows]
        value = column[order[rows]]
        by = np.lexsort((value, run))
        order[rows] = order[rows][by]
        value = value[by]
        differs = np.ones(len(rows), bool)
        differs[1:] = value[1:] != value[:-1]
        head[rows] |= differs  # run borders are heads already
    return order, np.cumsum(head) - 1


def _words8(matrix: np.ndarray) -> list[np.ndarray]:
    """Eight-byte columns of a byte matrix whose width is a multiple of eight."""
    keys = np.ascontiguousarray(matrix).view(">u8")
    return [keys[:, k].astype(np.uint64) for k in range(keys.shape[1])]


def _take(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Byte ranges as rows of a matrix, padded with zeros."""
    out = np.empty((len(start), width), np.uint8)
    column = np.arange(width)
    for a in range(0, len(start), 1 << 14):  # the matrix of positions is eight times the bytes
        rows = slice(a, a + (1 << 14))
        out[rows] = data[np.minimum(start[rows, None] + column, max(len(data) - 1, 0))]
        out[rows][column >= length[rows, None]] = 0
    return out


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Merge touching byte ranges of each document; returns them sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    base = doc.astype(np.int64)
    reach = np.maximum.accumulate(end + base * (1 << 40))  # documents are numbered: later ones reach further
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + base[1:] * (1 << 40) > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - base[last] * (1 << 40)


# ---- pruning -----------------------------------------------------------------

def _hash_rows(n_buckets: int):
    """Per slice and bucket: the low halves of its anchors' hashes with their rows."""
    def run(batches):
        for batch in T.slices(batches, max_bytes=SLICE_BYTES):
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            anchors = Anchors(*T.utf8(batch.column(2)), batch.column(3).is_valid().to_numpy(zero_copy_only=False))
            if not len(anchors.hash):
                continue
            bucket = ((anchors.hash >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
            low = anchors.hash.astype(np.uint32)
            order = np.lexsort((anchors.doc, low, bucket))
            bucket, low, doc = bucket[order], low[order], anchors.doc[order].astype(np.uint16)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
            bucket, low, doc = bucket[new], low[new], doc[new]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
                rows, mine = np.unique(doc[a:b], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket[a]], pa.int64()), pa.array([low[a:b].tobytes()], pa.binary()),
                     pa.array([mine.astype(np.uint16).tobytes()], pa.binary()),
                     pa.array([ids[rows].tobytes()], pa.binary()), pa.array([tags[rows].tobytes()], pa.binary())],
                    ["bucket", "low", "row", "ids", "tags"])
    return run


def _by_bucket(batches):
    """The rows of one bucket after another, from batches sorted by bucket (column 0); rows of no bucket (-1) as they come."""
    held = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield held
                held = []
            if key[a] < 0:
                yield [batch.slice(a, b - a)]
            else:
                held.append(batch.slice(a, b - a))
    if held:
        yield held


def _column(pieces, index: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of a bucket's rows as one array, and each row's number of items."""
    raw = [x for piece in pieces for x in piece.column(index).to_pylist()]
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind), np.array([len(x) // size for x in raw], np.int64)


_PACKED = "shard long, ids binary, tags binary, counts binary, data binary"


def _packed(ids: np.ndarray, tags: np.ndarray, counts: np.ndarray, data: np.ndarray, n_shards: int) -> pa.RecordBatch:
    """A row per shard with its documents' numbers: ``counts`` of them each, together in ``data``."""
    shard = np.mod(tags, n_shards)
    order = np.argsort(shard, kind="stable")
    base = np.cumsum(counts) - counts
    sizes = counts[order]
    at = np.repeat(base[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    data, shard = data[at].astype(np.uint32), shard[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    parts = np.split(data, ends[cuts[1:] - 1]) if len(cuts) else []
    binary = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
    split = lambda x: np.split(x[order], cuts[1:]) if len(cuts) else []
    return pa.RecordBatch.from_arrays(
        [T.int_array(shard[cuts].astype(np.int64)), binary(split(ids)), binary(split(tags)),
         binary(split(counts.astype(np.uint32))), binary(parts)], ["shard", "ids", "tags", "counts", "data"])


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    """The tag of each number's document, and the numbers, of a shard's packed rows."""
    pieces = rows.to_batches()
    tags, counts = _column(pieces, 2, np.int64)[0], _column(pieces, 3, np.uint32)[0]
    return np.repeat(tags, counts), _column(pieces, 4, np.uint32)[0]


def _shared_hashes(n_shards: int):
    """Per shard: the low hashes of its documents' anchors that two documents have."""
    def run(batches):
        for pieces in _by_bucket(batches):
            low, n = _column(pieces, 1, np.uint32)
            row, _ = _column(pieces, 2, np.uint16)
            ids, k = _column(pieces, 3, np.int64)
            tags, _ = _column(pieces, 4, np.int64)
            owner = row.astype(np.int64) + np.repeat(np.cumsum(k) - k, n)
            order = np.argsort(low, kind="stable")
            value, doc = low[order], ids[owner[order]]
            head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            many = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
            keep = order[np.repeat(many, np.diff(np.append(head, len(value))))]
            keep = keep[np.argsort(owner[keep], kind="stable")]
            if len(keep):
                who, counts = np.unique(owner[keep], return_counts=True)
                yield _packed(ids[who], tags[who], counts, low[keep], n_shards)
    return run


# ---- shipping and sorting -----------------------------------------------------

def _ranges(doc, start, end, ids, tags, n_shards: int) -> pa.RecordBatch:
    """Byte ranges of documents (numbers into ``ids`` and ``tags``), merged and packed by shard."""
    doc, start, end = _runs(doc, start, end)
    who, counts = np.unique(doc, return_counts=True)
    return _packed(ids[who], tags[who], 2 * counts, np.stack([start, end], 1).reshape(-1), n_shards)


_BINARY = ["ids", "tags", "owner", "start", "shape", "bytes"]
_SHIPPED = "bucket long, shard long, " + ", ".join(f"{c} binary" for c in _BINARY)
_SHIPPED_ARROW = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), *((c, pa.binary()) for c in _BINARY)])


def _suffix_rows(splitters: np.ndarray, n_shards: int):
    """Of a shard: packed ranges resolved inside its slices (bucket -1), and the suffixes that go on to each bucket."""
    def run(docs, shared):
        tag, low = _unpacked(shared)
        out = []
        for batch in T.slices(docs.to_batches(), max_bytes=SLICE_BYTES) if len(low) else ():
            out += ship(batch, tag, low)
        return pa.Table.from_batches(out, _SHIPPED_ARROW)

    def ship(batch, tag, low):
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # the wanted hashes of the slice's documents; rows that repeat one another share a tag
        by = np.argsort(tags, kind="stable")
        at = np.minimum(np.searchsorted(tags[by], tag), len(by) - 1)
        mine = tags[by[at]] == tag
        wanted = np.sort((by[at[mine]].astype(np.uint64) << np.uint64(32)) | low[mine].astype(np.uint64))
        data, offsets = T.utf8(batch.column(2))
        a = Anchors(data, offsets, np.isin(tags, tag))
        if not len(wanted) or not len(a.place):
            return
        key = a.hash.astype(np.uint32).astype(np.uint64) | (a.doc.astype(np.uint64) << np.uint64(32))
        live = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
        place, first, doc = a.place[live], a.first[live], a.doc[live]
        end = a.last[live] + LENGTH
        # equal suffixes of the slice: only those of the smallest document go on
        same = T.mix(T.span_hashes(data, first, end, a.acc) + (place - first).astype(np.uint64))
        order = np.lexsort((ids[doc], same))
        head = np.append(True, same[order][1:] != same[order][:-1])
        least = ids[doc][order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        done = order[ids[doc][order] > least]
        rest = order[ids[doc][order] == least]
        if len(done):
            base = offsets[doc[done]]
            found = _ranges(doc[done], first[done] - base, end[done] - base, ids, tags, n_shards)
            none = pa.array([None] * found.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([T.int_array(np.full(found.num_rows, -1)), *found.columns, none, none],
                                             schema=_SHIPPED_ARROW)
        bucket = np.searchsorted(splitters, _leading(data, place[rest]), "right")
        by = np.lexsort((doc[rest], bucket))
        rest, bucket = rest[by], bucket[by]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for x, y in zip(cuts, np.append(cuts[1:], len(bucket)) if len(bucket) else []):
            r = rest[x:y]
            rows, owner = np.unique(doc[r], return_inverse=True)
            length = end[r] - first[r]
            held = _take(data, first[r], length, int(length.max()))
            shape = (place[r] - first[r]).astype(np.uint16) | (length.astype(np.uint16) << np.uint16(8))
            text = held[np.arange(held.shape[1]) < length[:, None]].tobytes()
            blobs = (ids[rows], tags[rows], owner.astype(np.uint16), (first[r] - offsets[doc[r]]).astype(np.uint32), shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket[x]], pa.int64()), pa.array([None], pa.int64()),
                 *(pa.array([b.tobytes()], pa.binary()) for b in blobs),
                 pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())], schema=_SHIPPED_ARROW)
    return run


def _sorted_buckets(n_shards: int):
    """Packed byte ranges: those resolved before as they come, and those the sorted buckets give."""
    def run(batches):
        for pieces in _by_bucket(batches):
            if pieces[0].column(0)[0].as_py() < 0:
                for piece in pieces:
                    yield pa.RecordBatch.from_arrays(piece.columns[1:6], ["shard", "ids", "tags", "counts", "data"])
                continue
            ids, k = _column(pieces, 2, np.int64)
            tags, _ = _column(pieces, 3, np.int64)
            owner, n = _column(pieces, 4, np.uint16)
            owner = owner.astype(np.int64) + np.repeat(np.cumsum(k) - k, n)
            start = _column(pieces, 5, np.uint32)[0].astype(np.int64)
            shape = _column(pieces, 6, np.uint16)[0].astype(np.int64)
            size = np.add.reduceat(shape >> 8, np.cumsum(n) - n).tolist()
            packed = [x for piece in pieces for x in piece.column(7).to_pylist()]
            text = np.frombuffer(b"".join(pa.decompress(x, m, "zstd", asbytes=True) for x, m in zip(packed, size)), np.uint8)
            doc, a, b = resolve(ids[owner], start, shape & 255, shape >> 8, text)
            if len(doc):
                yield _ranges(owner[doc], a, b, ids, tags, n_shards)
    return run


def resolve(ids: np.ndarray, start: np.ndarray, before: np.ndarray, length: np.ndarray, text: np.ndarray):
    """Ranges (suffix number, start, end) that smaller documents also hold, of a bucket's suffixes.

    Suffix i belongs to document ``ids[i]``; ``length[i]`` bytes of it from ``start[i]`` on are in ``text``,
    its anchor lies ``before[i]`` bytes into them and its windows begin at the first ``length - LENGTH + 1``."""
    none = np.zeros(0, np.int64)
    n = len(ids)
    if n < 2:
        return none, none, none
    base = np.cumsum(length) - length
    # sort by the text from the anchor on, then the text before it and the lengths
    ahead = _words8(_take(text, base + before, length - before, 80))
    behind = _words8(_take(text, base, before, 32))
    order, run = multikey_sort([*ahead, *behind, length * 256 + before])
    del behind
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    least = np.repeat(np.minimum.reduceat(ids[order], head), np.diff(np.append(head, n)))
    covered = order[ids[order] > least]
    left = order[ids[order] == least]  # still in sorted order
    found = [(covered, start[covered], start[covered] + length[covered])]
    # what is left may share windows with other suffixes of its gram
    gram = np.ones(len(left), bool)
    mask = np.uint64(_MAX ^ ((1 << 32) - 1))
    keys = [ahead[0][left], ahead[1][left], ahead[2][left] & mask]  # GRAM == 20 bytes
    gram[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    del ahead, keys
    head = np.flatnonzero(gram)
    several = np.minimum.reduceat(ids[left], head) != np.maximum.reduceat(ids[left], head)
    size = np.diff(np.append(head, len(left)))
    keep = np.repeat(several, size)
    group = np.repeat(np.arange(len(head)), size)[keep]
    left = left[keep]
    windows = length[left] - LENGTH + 1
    which = np.repeat(np.arange(len(left)), windows)
    shift = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    # windows can be equal only at one distance from the anchor
    unit = group[which] * 64 + (before[left][which] - shift) + LENGTH
    by = np.argsort(unit, kind="stable")
    which, shift, unit = which[by], shift[by], unit[by]
    a = 0
    while a < len(unit):
        b = min(a + CHUNK, len(unit))
        while b < len(unit) and unit[b] == unit[b - 1]:
            b = int(np.searchsorted(unit, unit[b - 1], "right"))
        row = left[which[a:b]]
        held = _words8(_take(text, base[row] + shift[a:b], np.full(b - a, LENGTH), 56))
        order, run = multikey_sort([unit[a:b], *held])
        doc = ids[row][order]
        head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, b - a)))
        hit = order[doc > least]
        at = start[row[hit]] + shift[a:b][hit]
        found.append((row[hit], at, at + LENGTH))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found))


# ---- the operator ---------------------------------------------------------------

def _splitters(docs: DataFrame, n_buckets: int) -> np.ndarray:
    """Borders of the buckets: quantiles of the leading bytes of the anchors of a bounded sample."""
    def run(batches):
        for batch in T.slices(batches):
            data, offsets = T.utf8(batch.column(0))
            place = Anchors(data, offsets).place[::16]
            yield pa.RecordBatch.from_arrays([T.int_array(_leading(data, place).view(np.int64))], ["v"])

    if n_buckets < 2:
        return np.zeros(0, np.uint64)
    sample = docs.where(F.pmod(F.col("tag"), F.lit(16)) == 7).select("text").limit(SAMPLE_ROWS)
    cuts = (sample.mapInArrow(run, "v long")
            .select(F.percentile_approx(F.conv(F.hex("v"), 16, 10).cast("decimal(20,0)"),
                                        [k / n_buckets for k in range(1, n_buckets)], 10000)).first()[0])
    return np.unique(np.array([int(x) for x in cuts or []], np.uint64))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = spread_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", "doc_id").alias("tag"), "text", "doc_id")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_hash, n_buckets, n_shards = (max(1, -(-total // size)) for size in (HASH_BYTES, BUCKET_BYTES, SHARD_BYTES))
    splitters = _splitters(docs, n_buckets)

    # Read three times, exchanged once: every reader takes all its columns.
    dealt = docs.withColumn("shard", F.pmod("tag", F.lit(n_shards))).repartition("shard")
    shared = (dealt.mapInArrow(_hash_rows(n_hash), "bucket long, low binary, row binary, ids binary, tags binary")
              .repartition("bucket").sortWithinPartitions("bucket")
              .mapInArrow(_shared_hashes(n_shards), _PACKED))
    spans = (dealt.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_suffix_rows(splitters, n_shards), _SHIPPED)
             .repartition("bucket", F.when(F.col("bucket") < 0, F.col("shard"))).sortWithinPartitions("bucket")
             .mapInArrow(_sorted_buckets(n_shards), _PACKED))

    def finish(docs, spans):
        tag, number = _unpacked(spans)
        by = np.argsort(tag[::2], kind="stable")
        tag, pairs = tag[::2][by], number.reshape(-1, 2)[by].astype(np.int64)
        out = []
        for batch in T.slices(docs.to_batches(), max_bytes=SLICE_BYTES):
            data, offsets = T.utf8(batch.column(2))
            raw, tags = data.tobytes(), batch.column(1).to_numpy()
            low, high = np.searchsorted(tag, tags), np.searchsorted(tag, tags, "right")
            rows = []
            for k in range(batch.num_rows):
                a, b = int(offsets[k]), int(offsets[k + 1])
                mine = pairs[low[k]:high[k]]
                _, start, end = _runs(np.zeros(len(mine), np.int64), mine[:, 0], mine[:, 1])
                digest, at = hashlib.sha256(), a
                for s, e in zip(start.tolist(), end.tolist()):
                    digest.update(raw[at:a + s])
                    at = a + e
                digest.update(raw[at:b])
                rows.append((b - a, int((end - start).sum()), len(start), digest.hexdigest()))
            out.append(pa.RecordBatch.from_arrays(
                [batch.column(3), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(result)[1:]))], schema=result))
        return pa.Table.from_batches(out, result)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return (dealt.groupBy("shard").cogroup(spans.groupBy("shard"))
            .applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(hex(text), '') AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS k
  FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d WHERE len(h) >= 100)
), m AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM w) WHERE f < doc_id
), g AS (
  SELECT doc_id, i, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM m
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, r
), t AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS z FROM s GROUP BY doc_id
), pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a AS y FROM s
  UNION ALL SELECT doc_id, coalesce(z, 1), len(h) // 2 + 1 FROM d LEFT JOIN t USING (doc_id)
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * x - 1, 2 * (y - x)), '' ORDER BY x) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op1_suffix_dedup", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))
