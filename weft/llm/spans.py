"""Exact terms of Arrow text columns: byte runs and their numbering, equal numbers only for equal bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_set(members) -> np.ndarray:
    """Lookup table over the 256 bytes."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of bytes of the set ``inside``; no run crosses a text border."""
    member = inside[data]
    begin, stop = member.copy(), member.copy()
    begin[1:] &= ~member[:-1]
    stop[:-1] &= ~member[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first], stop[last] = member[first], member[last]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(offsets, start, "right") - 1


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of the runs ``[start, end)``, which must not overlap, as an Arrow string column."""
    size = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    body = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def numbered(terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each term and the distinct terms in byte order, so that numbers compare as the terms do."""
    coded = terms.dictionary_encode()
    distinct = coded.dictionary
    order = pc.sort_indices(distinct.cast(pa.large_binary())).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64), distinct.take(pa.array(order))


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of rows by integer columns and the heads of equal rows in that order."""
    order = np.lexsort(columns[::-1])
    head = np.ones(len(order), bool)
    if len(order):
        head[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, np.flatnonzero(head)


def codes(column) -> tuple[np.ndarray, list]:
    """Number of each row's value in a string column (null: empty) and the distinct values."""
    coded = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
