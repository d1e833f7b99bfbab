"""Anchors hierarchy: a metric tree of balls, built from the middle outwards, in numpy.

About the square root of the points become anchors: each new one is the point
farthest from its own anchor, and takes over the points that are nearer to it
(a point closer to its anchor than half the anchors' distance cannot be).
Upwards, the anchors' balls are merged two by two, the smallest joint ball
first; downwards, every anchor's points are divided in the same way until a
ball has ``leaf`` points or one place.  Every ball keeps the sum and number of
its points, its centroid and the radius around it.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa


def _anchors(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner of every point, pivots, radii): at most ``k`` anchors, fewer if the points have fewer places."""
    pivots = np.empty((k, x.shape[1]))
    pivots[0] = x[0]
    gap = x - x[0]
    far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    owner = np.zeros(len(x), dtype=np.int64)
    n = 1
    while n < k:
        new = int(far.argmax())
        if far[new] <= 0:
            break
        pivots[n] = x[new]
        apart = pivots[:n] - pivots[n]
        half = np.sqrt(np.einsum("ij,ij->i", apart, apart)) / 2
        maybe = np.flatnonzero(far > half[owner])
        gap = x[maybe] - pivots[n]
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        nearer = d < far[maybe]
        taken = maybe[nearer]
        owner[taken] = n
        far[taken] = d[nearer]
        n += 1
    radius = np.zeros(n)
    np.maximum.at(radius, owner, far)
    return owner, pivots[:n], radius


class _Grow:
    """Children of every node, and the points of every leaf, as the tree grows."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.leaf = x, leaf
        self.left, self.right, self.points = [], [], []

    def node(self, left: int = -1, right: int = -1, points: np.ndarray | None = None) -> int:
        self.left.append(left)
        self.right.append(right)
        self.points.append(points)
        return len(self.left) - 1

    def grow(self, points: np.ndarray) -> int:
        if len(points) <= self.leaf:
            return self.node(points=points)
        owner, pivot, radius = _anchors(self.x[points], max(2, math.ceil(math.sqrt(len(points)))))
        if len(pivot) == 1:
            return self.node(points=points)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(1, len(pivot)))
        return self.merge([self.grow(points[part]) for part in np.split(order, cut)], pivot, radius)

    def merge(self, nodes: list[int], centre: np.ndarray, radius: np.ndarray) -> int:
        """Pairs with the smallest joint ball become one, until one is left."""
        centre, radius, nodes = centre.copy(), radius.copy(), list(nodes)
        gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(-1))
        joint = np.maximum((gap + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
        np.fill_diagonal(joint, np.inf)
        for _ in range(len(nodes) - 1):
            a, b = divmod(int(joint.argmin()), len(nodes))
            r = joint[a, b]
            way = centre[b] - centre[a]
            d = math.sqrt(float(way @ way))
            if d + radius[b] > radius[a]:
                centre[a] = centre[b] if d + radius[a] <= radius[b] else centre[a] + way * ((r - radius[a]) / d)
            radius[a] = r
            nodes[a] = self.node(nodes[a], nodes[b])
            joint[b], joint[:, b] = np.inf, np.inf
            open_ = np.isfinite(joint[a])
            gap = np.sqrt(((centre[open_] - centre[a]) ** 2).sum(-1))
            joint[a, open_] = np.maximum((gap + radius[open_] + r) / 2, np.maximum(radius[open_], r))
            joint[open_, a] = joint[a, open_]
            top = nodes[a]
        return top


class BallTree:
    """``points`` (whole numbers, in tree order), their ``place`` in the input, and the balls: ``lo``:``hi`` ranges of points,
    ``left``/``right`` children (-1: leaf), ``centre``, ``radius``, ``total`` (sum of the points)."""

    def __init__(self, points: np.ndarray, leaf: int = 24):
        x = points.astype(np.float64)
        g = _Grow(x, leaf)
        top = g.grow(np.arange(len(x)))
        lo, hi, level = (np.zeros(len(g.left), dtype=np.int64) for _ in range(3))
        order, at, stack = [], 0, [(top, 0)]
        walk = []
        while stack:
            n, depth = stack.pop()
            walk.append(n)
            level[n] = depth
            if g.left[n] < 0:
                lo[n], hi[n] = at, at + len(g.points[n])
                order.append(g.points[n])
                at = hi[n]
            else:
                stack += [(g.right[n], depth + 1), (g.left[n], depth + 1)]
        for n in reversed(walk):
            if g.left[n] >= 0:
                lo[n], hi[n] = lo[g.left[n]], hi[g.right[n]]
        number = np.empty(len(walk), dtype=np.int64)          # the walk's order, so that the top is node 0
        number[walk] = np.arange(len(walk))
        child = lambda c: np.where(np.array(c)[walk] >= 0, number[np.array(c)[walk]], -1)
        self.left, self.right = child(g.left), child(g.right)
        self.lo, self.hi, level = lo[walk], hi[walk], level[walk]
        self.place = np.concatenate(order).astype(np.int32)
        self.points = points[self.place]
        run = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(self.points, axis=0)])
        self.total = run[self.hi] - run[self.lo]
        self.centre = self.total / (self.hi - self.lo)[:, None]
        self.radius = np.zeros(len(walk))
        x = self.points.astype(np.float64)
        for depth in range(int(level.max()) + 1):             # the balls of one level are disjoint ranges
            n = np.flatnonzero(level == depth)
            n = n[np.argsort(self.lo[n])]
            size = self.hi[n] - self.lo[n]
            rows = np.repeat(self.lo[n] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            gap = x[rows] - np.repeat(self.centre[n], size, axis=0)
            self.radius[n] = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", gap, gap), np.cumsum(size) - size))

    def dump(self) -> bytes:
        return pa.Codec("zstd").compress(raw := pickle.dumps(self.__dict__, protocol=5), asbytes=True) + len(raw).to_bytes(8, "little")

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        t = cls.__new__(cls)
        t.__dict__ = pickle.loads(pa.Codec("zstd").decompress(memoryview(data)[:-8], int.from_bytes(data[-8:], "little")))
        return t


def nearest_entry(x: np.ndarray, entries: np.ndarray, open_: np.ndarray | None = None) -> np.ndarray:
    """Nearest entry (squared distance, ties to the lower index) of every point among its ``open_`` ones; whole numbers, exact."""
    far = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * far * far < 1 << 52:                  # every term is a whole number that a double holds
        d = (entries.astype(np.float64) ** 2).sum(1)[None] - 2 * (x.astype(np.float64) @ entries.T.astype(np.float64))
        limit = np.inf
    else:
        d = np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)
        limit = np.iinfo(np.int64).max
    if open_ is not None:
        d[~open_] = limit
    return d.argmin(1)


class Assignment:
    """Points of a tree to their nearest entries, ball by ball."""

    def __init__(self, tree: BallTree, entries: np.ndarray):
        t, k = tree, len(entries)
        self.code = np.zeros(len(t.points), dtype=np.int16)
        self.count = np.zeros(k, dtype=np.int64)
        self.total = np.zeros((k, entries.shape[1]), dtype=np.int64)
        self.owned = 0                                        # points that came with a ball
        e = entries.astype(np.float64)
        square = (e * e).sum(1)
        between = np.sqrt(((e[:, None] - e[None]) ** 2).sum(-1))
        node, open_ = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        while len(node):
            c, r = t.centre[node], t.radius[node]
            own = (c * c).sum(1)
            d = own[:, None] + square[None] - 2 * (c @ e.T)
            d[~open_] = np.inf
            best = d.argmin(1)
            rows = np.arange(len(node))
            # an entry is out if the best one is nearer to every point of the ball; doubt (rounding, ties) keeps it
            slack = 1e-11 * (own[:, None] + square[None] + (r * r)[:, None]) + 1e-9
            open_ &= ~(d - d[rows, best][:, None] - 2 * r[:, None] * between[best] > slack)
            one = open_.sum(1) == 1
            same = ~one & (r == 0)                            # all points in one place
            if same.any():
                pick = nearest_entry(t.points[t.lo[node[same]]], entries, open_[same])
                best[same] = pick
                one |= same
            self._take(t, node[one], best[one])
            leaf = ~one & (t.left[node] < 0)
            if leaf.any():
                self._points(t, node[leaf], open_[leaf], entries)
            go = ~one & ~leaf
            open_ = np.repeat(open_[go], 2, axis=0)           # children inherit the list
            node = np.stack([t.left[node[go]], t.right[node[go]]], axis=1).ravel()

    def _take(self, t: BallTree, node: np.ndarray, entry: np.ndarray) -> None:
        """Whole balls: their cached sums and numbers."""
        size = t.hi[node] - t.lo[node]
        np.add.at(self.count, entry, size)
        np.add.at(self.total, entry, t.total[node])
        self.owned += int(size.sum())
        for a, b, c in zip(t.lo[node].tolist(), t.hi[node].tolist(), entry.tolist()):
            self.code[a:b] = c

    def _points(self, t: BallTree, node: np.ndarray, open_: np.ndarray, entries: np.ndarray) -> None:
        size = t.hi[node] - t.lo[node]
        rows = np.repeat(t.lo[node] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        x = t.points[rows]
        code = nearest_entry(x, entries, np.repeat(open_, size, axis=0))
        self.code[rows] = code
        self.count += np.bincount(code, minlength=len(entries))
        np.add.at(self.total, code, x)
