"""Vectorised byte and word primitives over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.
Everything works on slices of a few MB, so memory does not depend on how
long a text or how large an Arrow batch is (a single text longer than the
slice is a slice of its own).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = _splitmix(256, 7)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``radix**i`` and ``radix**-i`` modulo 2**64 for i < n (kept for reuse)."""
    global _powers
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_RADIX), -1, 1 << 64))
        both = []
        for base in (_RADIX, inverse):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (both[0], both[1])
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows of about ``most`` bytes."""
    before = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        raw, offsets = utf8(part)
        row, n = 0, len(offsets) - 1
        while row < n:
            end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
            end = min(max(end, row + 1), n)
            yield before + row, before + end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end
        before += n


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross rows."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit codes; [i] covers codes before i."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word (int64), the same wherever the word stands."""
    sums = prefix_hash(_BYTE_CODE[raw])
    h = (sums[end] - sums[start]) * powers(len(raw) + 1)[1][start]
    return mix(h + (end - start).astype(np.uint64)).view(np.int64)


def bounded_batches(spark, rows: int = 2000) -> None:
    """Arrow batches of ``rows`` rows, unless the session chose a number itself:
    at the default of 10,000 long texts make batches of many MB, of which the
    JVM, its pools and Python each hold some."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:
        return None


def _map_large_arrays() -> None:
    """Arrays of 1 MB and more get pages of their own, which go back when they
    are freed; by default malloc raises that bound and keeps them."""
    with contextlib.suppress(AttributeError):
        _libc().mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


_map_large_arrays()


def give_back() -> None:
    """Return memory that Arrow and malloc hold unused."""
    global _powers
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):
        _libc().malloc_trim(0)


def tidy(run):
    """A batch function that gives its memory back when its task ends, so idle
    Python workers do not hold what later stages need."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs (or its sum of weights)."""
    if weights is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, weights.dtype)


class Index:
    """Position of a key among distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, dtype=np.int64)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            missed = self.table[at] != left
            left, at = left[missed], (at[missed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _RADIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for absent keys."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._home(keys)
        found = self.table[at].astype(np.int64)
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found[open_] = self.table[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)
