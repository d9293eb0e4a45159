"""Vectorised word splitting and hashing over Arrow string columns.

A column is seen as one byte buffer with row offsets. Hashes of substrings come from prefix sums
of ``(b + 1) * B**i`` modulo 2**64 (``B`` is odd, so dividing by ``B**start`` is a multiplication),
which makes the hash of any byte range two lookups, with no Python object per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_LIBC = ctypes.CDLL(None)

BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that are white space: \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits and all bytes of other characters.
WORDY = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORDY[_lo : _hi + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def trim() -> None:
    """Give freed memory back to the system, as a worker lives on after a task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def groups(off: np.ndarray, most: int = 1 << 21):
    """Ranges of rows of about ``most`` bytes (a longer row stands alone), which bound the arrays in use."""
    at, rows = 0, len(off) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, end
        at = end


class Ranges:
    """Hashes of any byte ranges of a buffer."""

    def __init__(self, data: np.ndarray):
        self.data, self._sums = data, None

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range."""
        if self._sums is None:
            up, _ = _pow(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])
        down = _pow(len(self.data) + 1)[1]
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words(Ranges):
    """Words of each row: byte ranges ``start``/``end``, the hash of each, and ``rows`` (offsets by row)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = True):
        super().__init__(LOWER[data] if lower else data)
        self.off = off
        n = len(data)
        is_word = table[data]
        first = np.zeros(n + 1, bool)
        first[off] = True
        before = np.zeros(n, bool)
        before[1:] = is_word[:-1]
        self.start = np.flatnonzero(is_word & (~before | first[:n]))
        after = np.zeros(n, bool)
        after[:-1] = is_word[1:]
        self.end = np.flatnonzero(is_word & (~after | first[1 : n + 1])) + 1
        self.rows = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.start, self.end)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, wherever it starts (rows are not looked at); length len(h) - k + 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out *= np.uint64(BASE)
        out += h[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside each row, and their row offsets; a row of fewer words, but not none, has one of them all."""
    counts = np.diff(rows)
    full = np.maximum(counts - k + 1, 0)
    many = np.where(counts >= k, full, (counts > 0).astype(np.int64))
    out_rows = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(out_rows[-1], np.uint64)
    windows = window_hash(h, k)
    starts = np.zeros(len(h), bool)
    if len(windows):
        row = np.repeat(np.arange(len(counts)), counts)
        starts[: len(windows)] = row[: len(windows)] == row[k - 1 :]
    from_full = np.repeat(counts >= k, many)
    out[from_full] = windows[starts[: len(windows)]]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = rows[r], rows[r + 1]
        out[out_rows[r]] = window_hash(h[a:b], int(b - a))[0]
    return out, out_rows


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points that start before each byte (length + 1)."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
