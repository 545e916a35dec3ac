"""Vectorised text primitives on Arrow string buffers: words, word hashes, windows.

A word is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes never occur inside
another character, so everything here works on raw bytes and whole texts.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

SEP = np.zeros(256, dtype=bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)
OTHER = np.uint64(0xAEF17502108EF2D9)
SUB_BYTES = 1 << 20
CHECK_BITS = 24
NULL_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))  # a new array, the rest is in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def parts(offsets: np.ndarray, most: int = SUB_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each row, n + 1; word starts; word ends), as positions in data."""
    n = len(data)
    if n == 0:
        return np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    w = ~SEP[data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    starts = np.flatnonzero(begin)
    return np.searchsorted(starts, offsets), starts, np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    first = int(starts[0])
    body = data[first:]
    span = np.diff(np.append(starts, len(data)))
    at = np.arange(first, len(data), dtype=np.int64)
    at -= np.repeat(starts, span)
    keep = ~SEP[body]
    at *= keep
    value = (LOWER[body] if lower else body).astype(np.uint64)
    value += np.uint64(1)
    value *= powers(BASE, int((ends - starts).max()))[at]
    value *= keep
    return mix(np.add.reduceat(value, starts - first) + (ends - starts).astype(np.uint64) * STEP)


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all runs of `size` words inside a row: (hash, row, start in the row)."""
    lens = np.diff(first)
    count = np.maximum(lens - size + 1, 0)
    total = int(count.sum())
    row = np.repeat(np.arange(len(lens)), count)
    start = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    if total == 0:
        return np.zeros(0, dtype=np.uint64), row, start
    at = first[row] + start
    if size <= 6:
        out = h[at].copy()
        for k in range(1, size):
            out = out * STEP + h[at + k]
    else:
        out = rolled(h, at, size, STEP)
    return mix(out), row, start


def rolled(h: np.ndarray, at: np.ndarray, size: int, step: np.uint64) -> np.ndarray:
    """Polynomials of the runs of `size` words that start at the given words, by prefix sums."""
    p, inverse = powers(step, len(h)), powers(np.uint64(pow(int(step), -1, 1 << 64)), len(h))
    prefix = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * p, out=prefix[1:])
    return (prefix[at + size] - prefix[at]) * inverse[at]


def window_checks(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """CHECK_BITS more bits of the runs of `size` words at the given words, independent of windows()."""
    return (mix(rolled(mix(h ^ OTHER), at, size, OTHER)) & np.uint64((1 << CHECK_BITS) - 1)).astype(np.uint32)


def narrow(values: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the values."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(*columns: np.ndarray) -> bytes:
    """Equally long unsigned columns as bytes: count, widths, then each column."""
    widths = bytes(c.dtype.itemsize for c in columns)
    return len(columns[0]).to_bytes(4, "little") + widths + b"".join(c.tobytes() for c in columns)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:4], "little"), 4 + columns, []
    for w in blob[4 : 4 + columns]:
        out.append(np.frombuffer(blob, dtype=f"<u{w}", count=n, offset=at))
        at += n * w
    return out


def low(values: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of values, as so many bytes a value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def from_low(raw: bytes, n: int, offset: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=width * n, offset=offset).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def low7(h: np.ndarray) -> np.ndarray:
    """The low 56 bits as seven bytes a value."""
    return low(h, 7)


def from7(raw: bytes, n: int, offset: int = 0) -> np.ndarray:
    return from_low(raw, n, offset, 7)


def by_key(h: np.ndarray, c: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by h, then c, then the ties; whether each entry of it opens a new (h, c)). The checks c hardly ever differ where h is equal, so they are only sorted by if they do."""
    order = np.lexsort((*ties[::-1], h)) if ties else np.argsort(h, kind="stable")
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    if (~new[1:] & (c[order[1:]] != c[order[:-1]])).any():
        order = np.lexsort((*ties[::-1], c, h))
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
    return order, new


def fresh(taken: list[str], name: str) -> str:
    """A column name that no column has yet, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def ids_of(column: pa.Array) -> np.ndarray:
    """An integer id column as int64; null becomes NULL_ID."""
    if column.null_count:
        column = pc.fill_null(column.cast(pa.int64()), NULL_ID)
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


class Numbers:
    """Ids that are unique over the partitions of a stage and the same when a lost task runs again: the partition, then a count."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 36

    def take(self, n: int = 1) -> range:
        out = range(self.next, self.next + n)
        self.next += n
        return out


def trim() -> None:
    """Give memory that isn't in use back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run: Callable) -> Callable:
    """A partition function that trims its worker's memory when it ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied
