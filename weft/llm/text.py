"""Array helpers on Arrow text columns: bytes, words and hashes without a Python loop per row.

A column becomes one byte buffer plus offsets (null text: empty). Words are the
maximal runs of bytes other than space and \\t \\n \\v \\f \\r, which for UTF-8 is
the same as the character class ``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WORD = "[^\\x20\\x09-\\x0D]+"
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

# Powers of the rolling base, grown on demand and kept per Python worker.
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(max(n, 1 << 16), base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    """:func:`mix` of one Python integer."""
    return int(mix(np.array([x & _M], U64))[0])


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or
                              pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batches, column: str = "text", max_bytes: int = 1 << 21, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``max_bytes`` of text (one row at least) and few rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // max_bytes + (np.arange(n) // max_rows << 32)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


class Words:
    """Word boundaries of many texts: byte ranges ``start``/``end``, and the words
    ``first[d]:first[d + 1]`` of text ``d``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = ~_SEP[data]
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        a = offsets[:-1][offsets[:-1] < offsets[1:]]
        z = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        begin[a], stop[z] = word[a], word[z]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(LOWER[self.data] if lower else self.data, self.start, self.end)


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; differences of them hash any byte range."""
    acc = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0], out=acc[1:])
    return acc


_ODD = U64(0xD1B54A32D192ED03)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, acc: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte range: equal ranges have equal hashes wherever they stand. Eight bytes at a time are
    mixed in, without a polynomial that some texts are the roots of. With ``acc`` (:func:`prefix`) the
    ranges may overlap at no cost; that hash is a polynomial, for callers that compare bytes afterwards."""
    if not len(start):
        return np.zeros(0, U64)
    if acc is not None:
        inverse = powers(len(data) + 1)[1]
        return mix((acc[end] - acc[start]) * inverse[start] + (end - start).astype(U64))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    who, at, left = np.arange(len(start)), start, end - start
    out = mix(left.astype(U64) * _ODD + _ODD)
    while len(who):
        out[who] = mix((out[who] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)])) * _ODD)
        more = np.flatnonzero(left > 8)
        who, at, left = who[more], at[more] + 8, left[more] - 8
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start word of every run of ``k`` words that stays inside one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[j:j + n]
    ok = np.ones(n, bool)
    for j in range(1, k):  # a run that starts j words before a text's first word crosses into it
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    # empty or short texts repeat a boundary; the marks above already cover them
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def int_array(values, kind=pa.int64()) -> pa.Array:
    return pa.array(np.ascontiguousarray(values), kind)


def lists(values: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.ListArray:
    """Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), int_array(values, kind))


def unlist(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and list boundaries of an Arrow list column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return column.flatten().to_numpy(zero_copy_only=False), bounds


class HashIndex:
    """Hash → number lookup of distinct hashes: one probe into an open table, the rest sorted."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(10, int(len(hashes)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        slot = (hashes >> self.shift).astype(np.int64)
        self.slots[slot[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]
        lost = np.flatnonzero(self.slots[slot] != np.arange(len(hashes)))
        lost = lost[np.argsort(hashes[lost])]
        self.lost, self.lost_hash = lost, hashes[lost]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 if absent."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        got = self.slots[h >> self.shift].astype(np.int64)
        wrong = np.flatnonzero((got >= 0) & (self.hashes[got] != h))
        got[wrong] = -1
        if len(self.lost) and len(wrong):
            at = np.minimum(np.searchsorted(self.lost_hash, h[wrong]), len(self.lost) - 1)
            hit = self.lost_hash[at] == h[wrong]
            got[wrong[hit]] = self.lost[at[hit]]
        return got
