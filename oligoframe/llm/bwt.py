"""Column-wise construction of a Burrows-Wheeler transform over a collection of byte strings.

Round j inserts one symbol for every string of j symbols or more: the symbol before its suffix of length j, at that suffix's
place among all suffixes known so far. The place follows from the place of the suffix one shorter (number of smaller symbols,
plus equal symbols before it in the transform). The transform lives in a sequential file, which a round reads once from front
to back, merges the new symbols into and writes anew; in passing, it counts the equal symbols before each new one, for the
next round. Files stay in memory up to SPOOL bytes and go to the task's own scratch file beyond. Beside the file, a count of
each symbol in every BLOCK or so symbols is kept, and one place and one symbol for each string.

The finished transform is walked once to learn which suffix stands at each place, and neighbours are compared to tell where
the common prefix has at least a given length.
"""

from __future__ import annotations

import tempfile

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

SPOOL, PAGE, BLOCK, LARGEST = 1 << 25, 1 << 22, 192, 448
_BITS = np.packbits(np.arange(512) < np.arange(513)[:, None], axis=1).view(np.uint64)  # of a block, those before each place


class Page:
    """Sizes of the blocks of a stretch of the file, and the counts of each symbol in them."""

    def __init__(self, data: np.ndarray, alphabet: int):
        n = max(1, -(-len(data) // BLOCK))
        self.sizes = np.full(n, BLOCK, np.int64)
        self.sizes[-1] = len(data) - BLOCK * (n - 1)
        at = np.arange(len(data)) // BLOCK
        self.counts = np.bincount(at * alphabet + data, minlength=n * alphabet).reshape(n, alphabet).astype(np.int32)

    @property
    def size(self) -> int:
        return int(self.sizes.sum())

    def merge(self, data: np.ndarray, where: np.ndarray, symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretch with symbols at the places ``where`` of the result, and how often each occurs before its place."""
        out = np.empty(len(data) + len(where), np.uint8)
        old = np.ones(len(out), bool)
        old[where] = False
        out[where] = symbols
        out[old] = data
        ends = np.cumsum(self.sizes)
        block = np.minimum(np.searchsorted(ends, where - np.arange(len(where)), "right"), len(ends) - 1)
        more = np.bincount(block, minlength=len(ends))
        if (self.sizes + more).max() > LARGEST:
            self.__init__(out, alphabet)
            block = where // BLOCK
        else:
            self.sizes = self.sizes + more
            self.counts += np.bincount(block * alphabet + symbols, minlength=self.counts.size).reshape(self.counts.shape).astype(np.int32)
        starts = np.cumsum(self.sizes) - self.sizes
        before = np.cumsum(self.counts, 0, dtype=np.int32)
        before -= self.counts
        ranks = before[block, symbols].astype(np.int64)
        windows = sliding_window_view(np.concatenate((out, np.zeros(512, np.uint8))), 512)
        for i in range(0, len(where), 2048):  # bounds the matrix of blocks to 1 MB
            s = slice(i, i + 2048)
            equal = np.packbits(windows[starts[block[s]]] == symbols[s, None], axis=1).view(np.uint64)
            ranks[s] += np.bitwise_count(equal & _BITS[where[s] - starts[block[s]]]).sum(1, dtype=np.int64)
        return out, ranks


class Transform:
    """The file with its pages."""

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.file = self._new()
        self.pages = [Page(np.zeros(0, np.uint8), alphabet)]

    @staticmethod
    def _new():
        return tempfile.SpooledTemporaryFile(SPOOL)  # noqa: SIM115

    def read(self):
        self.file.seek(0)
        for page in self.pages:
            yield np.frombuffer(self.file.read(page.size), np.uint8)

    def insert(self, places: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the symbols at the places (ascending, as numbered afterwards). How often each occurs before its place, and the count of every symbol."""
        new, pages = self._new(), []
        ranks, seen = np.empty(len(places), np.int64), np.zeros(self.alphabet, np.int64)
        shift = places - np.arange(len(places))  # how many old symbols stand before each
        used = at = 0
        for k, (page, data) in enumerate(zip(self.pages, self.read(), strict=True)):
            last = k == len(self.pages) - 1
            to = len(places) if last else int(np.searchsorted(shift, at + len(data), "left"))
            s = slice(used, to)
            out, inside = page.merge(data, places[s] - (at + used), symbols[s], self.alphabet)
            ranks[s] = seen[symbols[s]] + inside
            seen += page.counts.sum(0)
            new.write(out.tobytes())
            pages += [page] if len(out) <= 2 * PAGE else [Page(out[i : i + PAGE], self.alphabet) for i in range(0, len(out), PAGE)]
            used, at = to, at + len(data)
        self.file.close()
        self.file, self.pages = new, pages
        return ranks, seen


class Collection:
    """The transform of distinct strings. Symbols are ranks of the bytes in use, from 1; 0 ends a string."""

    def __init__(self, strings: list[bytes]):
        self.n = len(strings)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        data = np.frombuffer(b"".join(strings), np.uint8)
        used = np.flatnonzero(np.bincount(data, minlength=256)) if len(data) else np.zeros(0, np.int64)
        code = np.zeros(256, np.uint8)
        if len(used) > 255:
            raise ValueError("a collection has 255 distinct bytes at most")
        code[used] = np.arange(1, len(used) + 1)
        self.alphabet = len(used) + 1
        self.coded = code[data]
        self.data = data

    def _before(self, which: np.ndarray, length: int) -> np.ndarray:
        """The symbol before the suffix of this length of each string."""
        left = self.sizes[which] - length
        at = self.offsets[which] + left - 1
        return np.where(left > 0, self.coded[np.maximum(at, 0)] if len(self.coded) else 0, 0).astype(np.uint8)

    def build(self) -> Transform:
        transform = Transform(self.alphabet)
        which = np.arange(self.n)
        symbols = self._before(which, 0)
        ranks, seen = transform.insert(which.astype(np.int64), symbols)
        for length in range(1, int(self.sizes.max(initial=0)) + 1):
            live = symbols > 0
            which, symbols, ranks = which[live], symbols[live], ranks[live]
            smaller = np.concatenate(([self.n], self.n + np.cumsum(seen[1:-1])))
            places = smaller[symbols.astype(np.int64) - 1] + ranks
            order = np.argsort(places, kind="stable")
            which, places = which[order], places[order]
            symbols = self._before(which, length)
            ranks, seen = transform.insert(places, symbols)
        return transform

    def walk(self, transform: Transform) -> tuple[np.ndarray, np.ndarray]:
        """(string, start) of the suffix at each place; start is the string's length for the empty suffix."""
        symbols = np.concatenate(list(transform.read()))
        step = np.empty(len(symbols), np.int32)
        ends = symbols == 0
        order = np.argsort(symbols[~ends], kind="stable")
        place_of = np.empty(len(order), np.int32)
        place_of[order] = np.arange(len(order), dtype=np.int32)
        step[~ends] = self.n + place_of
        string, start = np.empty(len(symbols), np.int32), np.empty(len(symbols), np.int32)
        which, place = np.arange(self.n), np.arange(self.n)
        for length in range(int(self.sizes.max(initial=0)) + 1):
            string[place], start[place] = which, self.sizes[which] - length
            live = symbols[place] > 0
            which, place = which[live], step[place[live]]
        return string, start

    def shared(self, length: int) -> list[list[int]]:
        """Of each string, the starts of its substrings of this length that also start elsewhere in the collection."""
        transform = self.build()
        string, start = self.walk(transform)
        transform.file.close()
        # Suffixes shorter than length stand between longer ones only where those differ within it.
        long = start + length <= self.sizes[string]
        string, start = string[long], start[long]
        at = self.offsets[string] + start
        same = np.zeros(len(at) + 1, bool)
        if len(at) > 1:
            windows = sliding_window_view(self.data, length)
            for i in range(0, len(at) - 1, 2048):
                b = at[i + 1 : i + 2049]
                same[i + 1 : i + 1 + len(b)] = _equal(windows[at[i : i + len(b)]], windows[b])
        hit = same[:-1] | same[1:]
        out: list[list[int]] = [[] for _ in range(self.n)]
        for s, x in zip(string[hit].tolist(), start[hit].tolist(), strict=True):
            out[s].append(x)
        return out


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of bytes are equal."""
    words = a.shape[1] // 8 * 8
    out = (a[:, words:] == b[:, words:]).all(1)
    if words:
        x, y = np.ascontiguousarray(a[:, :words]).view(np.uint64), np.ascontiguousarray(b[:, :words]).view(np.uint64)
        out &= (x == y).all(1)
    return out
