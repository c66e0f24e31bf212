"""Arrow kernels over sorted runs: the partial results of p1 and p5.

A run is the sorted content of one cell (plan, day, group) of one partition.  Kernels
take whole Arrow tables and work on columns, never on rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

BATCH = 1 << 20  # rows turned into runs at once: bounds a task's memory


def tables(batches, rows: int = BATCH):
    """Arrow batches gathered into tables of at least ``rows`` rows, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def slices(batches, values: int):
    """Arrow batches of runs cut between rows, so that the runs of a slice hold at most
    ``values`` values (column n) together, but for a single run of more.  However many
    bytes Spark puts into a batch, a kernel unpacks one slice of it at once."""
    for b in batches:
        upto = np.cumsum(b["n"].to_numpy())
        at, before = 0, 0
        while at < len(upto):
            to = max(at + 1, int(np.searchsorted(upto, before + values, side="right")))
            yield b.slice(at, to - at)
            at, before = to, upto[to - 1]


def codes(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row that is equal where all the columns are equal, NULL equal
    to NULL, and the first row of each number."""
    out = np.zeros(table.num_rows, np.int64)
    for name in names:
        col = table[name].combine_chunks().dictionary_encode()
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        idx = col.indices.fill_null(len(col.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, out = np.unique(out * (len(col.dictionary) + 1) + idx, return_inverse=True)
    first = np.full(int(out.max(initial=-1)) + 1, -1, np.int64)
    first[out[::-1]] = np.arange(len(out))[::-1]
    return out, first


def lists(table: pa.Table, names: list[str], rows: np.ndarray) -> pa.Array:
    """For each of ``rows`` the list of its values in the string columns."""
    k, n = len(names), len(rows)
    if not k:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    at = pa.array(rows)
    cols = pa.chunked_array([_flat(table[c]).take(at) for c in names], pa.string()).combine_chunks()
    mixed = cols.take(pa.array((np.arange(k)[None, :] * n + np.arange(n)[:, None]).ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, k * n + 1, k, dtype=np.int32)), mixed)


def _flat(col: pa.ChunkedArray) -> pa.Array:
    flat = col.combine_chunks()
    return flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Positions at which any of the parallel arrays changes, 0 first."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def union(cell: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-way union of sorted runs: distinct (cell, hash) pairs in order.  ``cell``
    does not fall; the runs of a cell follow each other.  The stable sort merges the
    sorted stretches that it finds, so k runs of n hashes take n log k steps."""
    if len(cell) and cell[0] == cell[-1]:
        h = np.sort(h, kind="stable")
    else:
        h = h[np.lexsort((h, cell))]
    keep = starts_of(cell, h)
    return cell[keep], h[keep]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values cut from one buffer at byte offsets (n + 1 of them)."""
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


def payload(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, and the n + 1 offsets of its values."""
    flat = _flat(col).cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(flat) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def pack(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Sorted uint64 runs as varints of their deltas; a run's first value is whole."""
    if not len(values):
        return pa.array([], pa.binary())
    d = values.copy()
    d[1:] -= values[:-1]
    d[starts] = values[starts]
    limits = np.array([1 << (7 * k) for k in range(1, 10)], np.uint64)
    size = np.searchsorted(limits, d, side="right") + 1
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]), np.uint8)
    at = ends - size
    for k in range(int(size.max())):
        live = size > k
        byte = ((d[live] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        byte |= np.where(size[live] > k + 1, 128, 0).astype(np.uint8)
        out[at[live] + k] = byte
    return binaries(out, np.concatenate([at[starts], ends[-1:]]))


def unpack(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all packed runs in a row, and the run of each value."""
    raw, offsets = payload(col)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    more = (end - start).astype(np.int8)  # bytes after the first
    del end
    # Byte by byte of all values, so that nothing is held for each byte of the runs.
    d = (raw[start] & 127).astype(np.uint64)
    for k in range(1, int(more.max()) + 1):
        live = slice(None) if more.min() >= k else np.flatnonzero(more >= k)
        d[live] |= (raw[start[live] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    count = np.diff(np.searchsorted(start, offsets))
    del start
    total = np.cumsum(d)  # wraps; differences stay right
    size = count[count > 0]
    first = np.cumsum(size) - size
    total -= np.repeat(total[first] - d[first], size)
    return total, np.repeat(np.arange(len(count)), count)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
