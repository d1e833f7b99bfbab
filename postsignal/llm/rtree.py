"""STR-packed R-tree over labelled whole-number vectors, and best-first searches by inner product, in numpy.

Packing is sort-tile-recursive: rows are sorted by label, then cut into slabs by
one coordinate after the other (widest first) until a tile fills a leaf; ``fan``
neighbours in that order share a parent.  A box knows, besides the least and
largest value of every coordinate, the least and largest label and the least id
below it.  With a query ``q``, a coordinate's values ``[lo, hi]`` give its product
the interval ``[q * lo, q * hi]`` (turned round for negative ``q``); the sums over all
coordinates bound every inner product in the box.
"""

from __future__ import annotations

import math
import pickle
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa


def _str_order(x: np.ndarray, rows: np.ndarray, leaf: int, axes: np.ndarray) -> list[np.ndarray]:
    """Tiles of at most ``leaf`` rows: slabs along the first axis, each tiled along the others."""
    tiles = math.ceil(len(rows) / leaf)
    if tiles <= 1 or not len(axes):
        return [rows[i:i + leaf] for i in range(0, len(rows), leaf)]
    slabs = math.ceil(tiles ** (1 / len(axes)))
    size = math.ceil(tiles / slabs) * leaf
    rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
    return [t for i in range(0, len(rows), size) for t in _str_order(x, rows[i:i + size], leaf, axes[1:])]


class RTree:
    """``x``, ``label``, ``first`` (a row's ids are ``ids[first[r]:first[r + 1]]``, ascending), all in tree order; boxes of all
    levels one after another, leaves first: ``low``, ``high``, ``label_low``, ``label_high``, ``least`` (id), ``begin``/``end``
    (rows of a leaf, boxes of a parent); ``leaves``: their number.  The last box is the root."""

    def __init__(self, x: np.ndarray, label: np.ndarray, ids: list[np.ndarray], leaf: int = 64, fan: int = 16):
        order = np.argsort(label, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
        groups, held = [], []
        for g in np.split(order, start[1:]):                    # small labels share a tile, others have their own
            if len(g) >= leaf // 2:
                groups += [np.concatenate(held)] if held else []
                groups.append(g)
                held = []
            else:
                if held and sum(map(len, held)) + len(g) > leaf:
                    groups.append(np.concatenate(held))
                    held = []
                held.append(g)
        groups += [np.concatenate(held)] if held else []
        tiles = []
        for g in groups:
            depth = max(1, min(x.shape[1], int(math.log2(max(2, len(g) / leaf)))))
            tiles += _str_order(x, g, leaf, np.argsort(-x[g].astype(np.float64).var(axis=0), kind="stable")[:depth])
        place = np.concatenate(tiles)
        self.x, self.label = x[place], label[place]
        size = np.array([len(ids[r]) for r in place])
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.ids = np.concatenate([ids[r] for r in place])
        cut = np.cumsum([0] + [len(t) for t in tiles])
        least = np.minimum.reduceat(self.ids, self.first[:-1])
        level = [cut[:-1], cut[1:], np.minimum.reduceat(self.x, cut[:-1]), np.maximum.reduceat(self.x, cut[:-1]),
                 np.minimum.reduceat(self.label, cut[:-1]), np.maximum.reduceat(self.label, cut[:-1]), np.minimum.reduceat(least, cut[:-1])]
        levels, below, self.leaves = [level], 0, len(tiles)
        while len(level[0]) > 1:
            n = len(level[0])
            a = np.arange(0, n, fan)
            level = [below + a, below + np.minimum(a + fan, n), np.minimum.reduceat(level[2], a), np.maximum.reduceat(level[3], a),
                     np.minimum.reduceat(level[4], a), np.maximum.reduceat(level[5], a), np.minimum.reduceat(level[6], a)]
            below += n
            levels.append(level)
        self.begin, self.end, self.low, self.high, self.label_low, self.label_high, self.least = (np.concatenate(c) for c in zip(*levels))

    def dump(self) -> bytes:
        raw = pickle.dumps(self.__dict__, protocol=5)
        return pa.Codec("zstd").compress(raw, asbytes=True) + len(raw).to_bytes(8, "little")

    @classmethod
    def load(cls, data: bytes) -> RTree:
        t = cls.__new__(cls)
        t.__dict__ = pickle.loads(pa.Codec("zstd").decompress(memoryview(data)[:-8], int.from_bytes(data[-8:], "little")))
        return t


def exact_type(*arrays: np.ndarray):
    """double if it holds every sum of products of the arrays' numbers exactly, else int64 (slower)."""
    far = [int(np.abs(a).max(initial=0)) for a in arrays]
    return np.float64 if arrays[0].shape[-1] * max(far) ** 2 < 1 << 53 else np.int64


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) inner product of every query with any vector of every box, (queries, boxes) whole numbers."""
    kind = exact_type(q, low, high)
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    low, high = low.astype(kind).T, high.astype(kind).T
    return (up @ low + down @ high).astype(np.int64), (up @ high + down @ low).astype(np.int64)


class Searcher:
    """Searches of one tree for a batch of queries."""

    def __init__(self, tree: RTree, q: np.ndarray):
        self.t, self.kind = tree, exact_type(q, tree.x)
        self.x, self.q = tree.x.astype(self.kind, copy=False), q.astype(self.kind)
        self.least, self.most = intervals(q, tree.low, tree.high)
        self.opened = 0                                         # leaves looked at

    def _scores(self, n: int, leaf: int) -> np.ndarray:
        self.opened += 1
        return self.x[self.t.begin[leaf]:self.t.end[leaf]] @ self.q[n]

    def positives(self, n: int, label: int, own: int, k: int, floor: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """(-score, id) of the first ``k`` rows of ``label`` but ``own``, best first; none after ``floor``, a (-score, id)."""
        t, most = self.t, self.most[n]
        root = len(t.begin) - 1
        queue, found = [(-int(most[root]), int(t.least[root]), root)], []
        bar = floor
        while queue:
            top, least, box = heappop(queue)
            if bar is not None and (top, least) > bar:           # every other box is as bad
                break
            if not t.label_low[box] <= label <= t.label_high[box]:
                continue
            a, b = int(t.begin[box]), int(t.end[box])
            if box >= t.leaves:
                for c in range(a, b):
                    if bar is None or (-int(most[c]), int(t.least[c])) <= bar:
                        heappush(queue, (-int(most[c]), int(t.least[c]), c))
                continue
            score = self._scores(n, box)
            fit = t.label[a:b] == label
            if bar is not None:
                fit &= score >= -bar[0]
            for r in np.flatnonzero(fit).tolist():
                found += [(-int(score[r]), i) for i in t.ids[t.first[a + r]:t.first[a + r + 1]].tolist() if i != own]
            found = sorted(found)[:k]
            if len(found) == k:
                bar = found[-1] if bar is None else min(bar, found[-1])
        return [f for f in found if bar is None or f <= bar]

    def negatives(self, n: int, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each (low, high): (-score, id) of the first ``k`` rows of other labels that score within it, best first."""
        t, most, least_score = self.t, self.most[n], self.least[n]
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        bars = [(-low, math.inf) for low, _ in windows]          # a row later than that (-score, id) is of no use
        worst = max(bars, default=(math.inf, math.inf))
        ceiling = max((h for _, h in windows), default=0)

        def wanted(box: int) -> bool:
            if t.label_low[box] == t.label_high[box] == label:
                return False
            hi, lo, i = int(most[box]), int(least_score[box]), int(t.least[box])
            return any(lo <= h and (-min(hi, h), i) <= bar for (_, h), bar in zip(windows, bars))

        root = len(t.begin) - 1
        queue = [(-int(most[root]), root)]
        heapify(queue)
        while queue:
            top, box = heappop(queue)
            if top > worst[0]:
                break
            if not wanted(box):
                continue
            a, b = int(t.begin[box]), int(t.end[box])
            if box >= t.leaves:
                for c in range(a, b):
                    if wanted(c):
                        heappush(queue, (-int(most[c]), c))
                continue
            score = self._scores(n, box)
            rows = np.flatnonzero((score >= -worst[0]) & (score <= ceiling) & (t.label[a:b] != label))
            for r in rows.tolist():
                s = int(score[r])
                ids = t.ids[t.first[a + r]:t.first[a + r + 1]].tolist()
                for w, (low, high) in enumerate(windows):
                    if low <= s <= high and (-s, ids[0]) <= bars[w]:
                        found[w] = sorted(found[w] + [(-s, i) for i in ids])[:k]
                        if len(found[w]) == k:
                            bars[w] = found[w][-1]
            if len(rows):
                worst = max(bars)
        return found
