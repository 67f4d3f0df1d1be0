"""Vectorised text primitives over Arrow string columns.

A text column is handled as one byte buffer with offsets. Words are hashed with a
tabulated polynomial hash modulo 2^64: prefix sums of ``table[byte] * P**position``
give every word's hash by one subtraction and one multiplication with ``P**-start``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


RAW = _table(0x51)
LOWER = RAW.copy()
LOWER[65:91] = RAW[97:123]

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 4))
        for_all = np.full(size, _P, dtype=U64)
        for_all[0] = 1
        back = np.full(size, _P_INV, dtype=U64)
        back[0] = 1
        _pow, _inv = np.cumprod(for_all, dtype=U64), np.cumprod(back, dtype=U64)
    return _pow, _inv


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in runs of at most ``most`` bytes of text (a longer text
    makes a run of its own), so that working arrays stay bounded."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of bytes that are no separators."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of byte spans."""
    power, back = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(table[buf] * power[: len(buf)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64))


def fold_latin1(buf: np.ndarray) -> np.ndarray:
    """Lower-case the two-byte letters U+00C0..U+00DE."""
    if not len(buf):
        return buf
    second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    at = np.flatnonzero(second) + 1
    if len(at):
        buf = buf.copy()
        buf[at] += 0x20
    return buf


def words(batch_column: pa.Array, separator: np.ndarray = SPACE, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (ASCII case folded) of all rows, and row bounds into them."""
    buf, offsets = text_buffer(batch_column)
    if fold:
        buf = fold_latin1(buf)
    starts, ends, rows = spans(buf, offsets, separator)
    bounds = np.searchsorted(rows, np.arange(len(offsets)), "left")
    return span_hashes(buf, starts, ends), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within each row, and row bounds. A row of
    fewer words, but at least one, has all its words as its one shingle."""
    counts = np.diff(bounds)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(made)))
    total = int(out_bounds[-1])
    rows = np.repeat(np.arange(len(counts)), made)
    at = np.arange(total) - out_bounds[rows] + bounds[rows]
    width = np.minimum(counts, size)[rows]
    value = width.astype(U64)
    padded = np.concatenate((hashes, np.zeros(size, U64)))
    for k in range(size):
        step = mix64(value * U64(0x2545F4914F6CDD1D) ^ padded[at + k])
        value = np.where(k < width, step, value)
    return value, out_bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
