"""Whole-text word tables in numpy, shared by the operators that run in Arrow batches.

A word is a run of bytes outside ``0x20`` and ``0x09``-``0x0D`` (these bytes
never occur inside a multi-byte UTF-8 character), with ``A``-``Z`` lower-cased.
Words are found and hashed for many documents at once on the UTF-8 buffer of
the Arrow column: a word's hash is a polynomial over its bytes modulo 2**64,
taken from one running sum, then mixed.  Work memory is bounded by ``SEGMENT``
bytes (one longer word excepted), whatever the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 17          # bytes hashed at a time
CHUNK = 4 << 20            # bytes of documents handed to an operator at a time

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); ``seed`` picks the function."""
    x = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, its nulls as empty texts; no copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    o = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return b[o[0]:o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of some documents: ``start``/``end`` byte places, ``doc`` index, ``hash``; ``first[d]:first[d+1]`` are d's."""

    __slots__ = ("start", "end", "doc", "hash", "first")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, fold: bool = True):
        """``fold``: hash with A-Z lower-cased."""
        parts = []
        n, at = len(buf), 0
        edge = offsets[1:-1]
        while at < n:
            to = min(at + SEGMENT, n)
            if to < n:                                  # move the cut to a place that splits no word
                gap = np.flatnonzero(_SPACE[buf[at:to]])
                e = edge[np.searchsorted(edge, to, side="right") - 1] if len(edge) else 0
                cut = max(at + int(gap[-1]) + 1 if len(gap) else 0, int(e))
                if cut <= at:                           # one word longer than a segment
                    k = np.searchsorted(edge, to)
                    stop = int(edge[k]) if k < len(edge) else n
                    cut = stop
                    for p in range(to, stop, SEGMENT):
                        gap = np.flatnonzero(_SPACE[buf[p:min(p + SEGMENT, stop)]])
                        if len(gap):
                            cut = p + int(gap[0]) + 1
                            break
                to = cut
            parts.append(self._segment(buf[at:to], at, edge, fold))
            at = to
        if parts:
            self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts))
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
        docs = len(offsets) - 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(self.first))

    @staticmethod
    def _segment(b: np.ndarray, at: int, edge: np.ndarray, fold: bool):
        n = len(b)
        word = np.zeros(n + 2, dtype=bool)
        np.logical_not(_SPACE[b], out=word[1:-1])
        begins, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        inner = edge[(edge > at) & (edge < at + n)] - at     # a document's first byte begins a word
        begins[inner] = word[inner + 1]
        ends[inner - 1] = word[inner]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        value = _BYTE[_LOWER[b] if fold else b]
        value *= power[:n]
        np.cumsum(value, out=total[1:])
        h = total[e]
        h -= total[s]
        h *= inverse[s]
        return s + at, e + at, mix(h, 1)

    def __len__(self) -> int:
        return len(self.start)


_STEP = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(16)]


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside each document, and each document's range of them."""
    count = np.maximum(np.diff(first) - (n - 1), 0)
    to = np.concatenate([[0], np.cumsum(count)])
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64), to
    x = h[:len(h) - n + 1] * _STEP[0]
    for k in range(1, n):
        x += h[k:len(h) - n + 1 + k] * _STEP[k]
    doc_of = np.repeat(np.arange(len(count)), np.diff(first))
    inside = doc_of[:len(x)] == doc_of[n - 1:]
    return mix(x[inside], 100 + n), to


def shingle_sets(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct ``k``-word shingle hashes, flat, and its ranges.

    With fewer than ``k`` words the whole sequence is the one shingle; without
    words the set is empty.
    """
    long, to = ngrams(w.hash, w.first, k)
    size = np.diff(w.first)
    out, ends = [], np.zeros(len(size) + 1, dtype=np.int64)
    for d in range(len(size)):
        if size[d] >= k:
            s = np.unique(long[to[d]:to[d + 1]]) if to[d + 1] - to[d] > 1 else long[to[d]:to[d + 1]]
        elif size[d]:
            x = w.hash[w.first[d]:w.first[d + 1]]
            s = mix((x * np.array(_STEP[:len(x)], dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64), 200 + len(x))
        else:
            s = x = long[:0]
        out.append(s)
        ends[d + 1] = ends[d] + len(s)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), ends


def distinct(h: np.ndarray, bits: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """(place of one occurrence of every distinct hash, number of that hash for every element); linear, unordered."""
    n = len(h)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    table = np.empty(1 << bits, dtype=np.int32)
    table[slot] = np.arange(n, dtype=np.int32)
    rep = table[slot].astype(np.int64)
    clash = np.flatnonzero(h[rep] != h)                 # another hash has this slot
    if len(clash):
        _, at, inverse = np.unique(h[clash], return_index=True, return_inverse=True)
        rep[clash] = clash[at][inverse]
    places = np.flatnonzero(rep == np.arange(n))
    number = np.empty(n, dtype=np.int64)
    number[places] = np.arange(len(places))
    return places, number[rep]
