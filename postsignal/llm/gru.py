"""Bidirectional gated recurrent layers with attention pooling, in numpy: forward, backward, Adam.

Sequences lie end to end in flat arrays (``start``, ``size`` of each, longest
first), so a step works on the sequences that are still open and no padding is
computed.  Input projections are rows of a table (one per distinct input) that
steps gather from.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.exp(-np.clip(x, -30, 30))
    y += 1
    return np.reciprocal(y, out=y)


def init(rng: np.random.Generator, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    """Weights of one bidirectional layer and its attention."""
    def m(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {}
    for d in "fb":
        p |= {f"x{d}": m(inputs, 3 * hidden), f"u{d}": m(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, dtype=np.float32)}
    p["att"] = m(2 * hidden)
    return p


def _places(start: np.ndarray, size: np.ndarray, t: int, n: int, back: bool) -> np.ndarray:
    return (start[:n] + size[:n] - 1 - t) if back else start[:n] + t


def run(p: dict, d: str, table: np.ndarray, tok: np.ndarray, start: np.ndarray, size: np.ndarray, out: np.ndarray, keep: list | None = None) -> None:
    """One direction; writes each position's state into ``out`` (positions, hidden)."""
    hidden = out.shape[1]
    u = p[f"u{d}"]
    h = np.zeros((len(start), hidden), dtype=np.float32)
    longest = int(size[0]) if len(size) else 0
    open_ = np.searchsorted(-size, -np.arange(longest), side="left")      # sequences longer than t
    for t in range(longest):
        n = open_[t]
        at = _places(start, size, t, n, d == "b")
        g = table[tok[at]]
        hp = h[:n]
        a = hp @ u
        zr = sigmoid(g[:, :2 * hidden] + a[:, :2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        an = a[:, 2 * hidden:]
        c = sigmoid(2 * (g[:, 2 * hidden:] + r * an))
        c *= 2
        c -= 1
        new = c + z * (hp - c)
        out[at] = new
        if keep is not None:
            keep.append((at, hp.copy(), z, r, c, an))
        h[:n] = new


def back(p: dict, d: str, keep: list, rows: int, tok: np.ndarray, dout: np.ndarray, count: int, grad: dict) -> np.ndarray:
    """Gradient of one direction: adds to ``grad`` and returns that of the projected inputs (distinct inputs, 3 hidden)."""
    hidden = dout.shape[1]
    u = p[f"u{d}"]
    dh = np.zeros((rows, hidden), dtype=np.float32)
    dtable = np.zeros((count, 3 * hidden), dtype=np.float32)
    for at, hp, z, r, c, an in reversed(keep):
        n = len(at)
        g = dh[:n] + dout[at]
        dc = g * (1 - z) * (1 - c * c)
        dz = g * (hp - c) * z * (1 - z)
        dr = dc * an * r * (1 - r)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        grad[f"u{d}"] += hp.T @ da
        dh[:n] = g * z + da @ u.T
        np.add.at(dtable, tok[at], np.concatenate([dz, dr, dc], axis=1))
    return dtable


def _spread(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(x, size, axis=0)


class Layer:
    """Forward pass over sequences; ``pooled`` is the attention-weighted mean of both directions' states."""

    def __init__(self, p: dict, x: np.ndarray, tok: np.ndarray, start: np.ndarray, size: np.ndarray, learn: bool = False,
                 tables: tuple[np.ndarray, np.ndarray] | None = None):
        hidden = len(p["uf"])
        self.p, self.x, self.tok, self.start, self.size = p, x, tok, start, size
        tables = tables or project(p, x)
        self.states = np.empty((len(tok), 2 * hidden), dtype=np.float32)
        self.kept = {"f": [], "b": []} if learn else {"f": None, "b": None}
        for k, d in enumerate("fb"):
            part = np.empty((len(tok), hidden), dtype=np.float32)
            run(p, d, tables[k], tok, start, size, part, self.kept[d])
            self.states[:, k * hidden:(k + 1) * hidden] = part
        e = np.exp(np.clip(self.states @ p["att"], -30, 30) * 4)           # bounded states: no shift is needed
        order = np.argsort(start, kind="stable")
        total = np.empty(len(start), dtype=np.float32)
        total[order] = np.add.reduceat(e, start[order])
        self.alpha = np.empty(len(tok), dtype=np.float32)
        self.alpha[:] = e
        by = size[order]
        self.alpha /= _spread(total[order], by)
        self.order, self.by = order, by
        self.pooled = np.empty((len(start), 2 * hidden), dtype=np.float32)
        self.pooled[order] = np.add.reduceat(self.states * self.alpha[:, None], start[order], axis=0)

    def backward(self, dpooled: np.ndarray, grad: dict) -> np.ndarray:
        """Adds to ``grad``; returns the gradient of ``x``."""
        p, hidden = self.p, len(self.p["uf"])
        dp = _spread(dpooled[self.order], self.by)
        da = (dp * self.states).sum(axis=1)
        mean = np.add.reduceat(da * self.alpha, self.start[self.order])
        de = 4 * self.alpha * (da - _spread(mean, self.by))
        grad["att"] += self.states.T @ de
        ds = dp * self.alpha[:, None] + de[:, None] * p["att"]
        dx = np.zeros_like(self.x)
        for k, d in enumerate("fb"):
            dt = back(p, d, self.kept[d], len(self.start), self.tok, ds[:, k * hidden:(k + 1) * hidden], len(self.x), grad)
            grad[f"x{d}"] += self.x.T @ dt
            grad[f"b{d}"] += dt.sum(axis=0)
            dx += dt @ p[f"x{d}"].T
        return dx


def project(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input projections of both directions."""
    return x @ p["xf"] + p["bf"], x @ p["xb"] + p["bb"]


class Adam:
    def __init__(self, params: list[dict], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [{k: np.zeros_like(v) for k, v in p.items()} for p in params]
        self.v = [{k: np.zeros_like(v) for k, v in p.items()} for p in params]

    def step(self, grads: list[dict], rate: float | None = None) -> None:
        self.t += 1
        rate = (rate or self.rate) * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        norm = np.sqrt(sum(float((g * g).sum()) for gs in grads for g in gs.values()))
        shrink = np.float32(min(1.0, 5.0 / max(norm, 1e-12)))
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            for k in p:
                x = g[k] * shrink
                m[k] += np.float32(0.1) * (x - m[k])
                v[k] += np.float32(0.001) * (x * x - v[k])
                p[k] -= np.float32(rate) * m[k] / (np.sqrt(v[k]) + np.float32(1e-8))
