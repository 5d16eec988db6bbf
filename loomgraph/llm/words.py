"""Vectorised word hashing of Arrow string columns, shared by the text operators.

A word is a longest run of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z count as a-z.
Nulls count as empty texts. Texts are taken whole, in chunks of whole documents of about ``CHUNK``
bytes (a longer document is a chunk of its own). Beside the text itself, three bytes of marks a byte and 24 bytes
a word are held for a chunk; hashing goes over it ``CHUNK`` bytes at a time, whatever the length of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 12


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64."""
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_LOW = _powers(_BASE, _STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_word(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of a word."""
    return _IS_WORD[data]


class Words:
    """The words of a run of documents: ``hashes``, byte spans ``starts``/``ends`` in ``data``, and
    ``first``, where the words of document i begin (``first[i]:first[i + 1]``)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lo: int, hashed: bool = True):
        self.data, self.lo = data, lo
        docs = len(bounds) - 1
        word = is_word(data)
        start, end = word.copy(), word.copy()
        if len(data):
            start[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            cuts = bounds[1:-1]
            at = cuts[(cuts < len(data)) & (cuts > 0)]
            start[at] = word[at]
            end[at - 1] = word[at - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = self._hashed(word) if hashed else None
        self.docs = docs

    def _hashed(self, word: np.ndarray) -> np.ndarray:
        """Of each word: its bytes, each times the power of the base that its place in the word says, summed up."""
        sums = np.zeros(len(self.starts), np.uint64)
        longest = int((self.ends - self.starts).max(initial=1))
        high = _powers(pow(_BASE, _STEP, 1 << 64), (longest - 1) // _STEP + 1)
        for lo in range(int(self.starts[0]) if len(sums) else len(self.data), len(self.data), CHUNK):
            hi = min(lo + CHUNK, len(self.data))
            a, b = int(np.searchsorted(self.starts, lo, "right")) - 1, int(np.searchsorted(self.starts, hi))
            begins = np.maximum(self.starts[a:b], lo)
            place = np.arange(lo, hi) - np.repeat(self.starts[a:b], np.diff(np.append(begins, hi)))
            value = np.where(word[lo:hi], _LOWER[self.data[lo:hi]], np.uint64(0)) * _LOW[place & (_STEP - 1)]
            if longest > _STEP:
                value *= high[np.minimum(place // _STEP, len(high) - 1)]  # beyond a word's end there are only zeros
            sums[a:b] += np.add.reduceat(value, begins - lo)
        return mix(sums)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))


def chunks(column: pa.Array | pa.ChunkedArray, hashed: bool = True) -> Iterator[Words]:
    """The words of a string column, document by document in order, with or without hashes of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + CHUNK, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lo, hashed)
        lo = hi
    pa.default_memory_pool().release_unused()  # a worker waits for its next task with what it keeps here


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words, and where the runs of each document begin.

    A document of fewer words gives one hash for its whole sequence, one without words none.
    """
    h, counts = words.hashes, np.diff(words.first)
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[: max(n - j, 0)] = h[j:]
        rolled = mix(rolled * np.uint64(3) + part + np.uint64(j + 1))
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    take = np.arange(first[-1]) - np.repeat(first[:-1], runs) + np.repeat(words.first[:-1], runs)
    out = rolled[take]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        whole = np.array([counts[i]], np.uint64)
        for x in h[words.first[i] : words.first[i + 1]]:
            whole = mix(whole * np.uint64(3) + x)
        out[first[i]] = mix(whole ^ np.uint64(0xA5A5A5A5))[0]
    return out, first
