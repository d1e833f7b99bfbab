"""Fast similarity sketching of shingle sets and its banding, in numpy.

A sketch has ``t`` coordinates filled in up to ``2t`` rounds.  In round
``i < t`` every element falls into one random bin and offers the value
``(i, hash)``; in round ``t + j`` every element falls into bin ``j``, so no bin
stays empty.  A bin keeps its smallest offer; a set leaves the rounds as soon as
all its bins are full, since later rounds only offer larger values.  Two
sketches agree in a coordinate with probability equal to the sets' Jaccard
similarity, with the concentration of independent coordinates.
"""

from __future__ import annotations

import numpy as np

from .textkit import mix

_ROUND_SHIFT = np.uint64(52)       # the round stands above 52 bits of hash


def sketches(flat: np.ndarray, ends: np.ndarray, t: int, seed: int = 7) -> np.ndarray:
    """(sets, t) sketch of the non-empty sets ``flat[ends[d]:ends[d+1]]``; empty sets get the largest value."""
    sets = len(ends) - 1
    out = np.full(sets * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    size = np.diff(ends)
    doc = np.repeat(np.arange(sets), size)
    x = flat
    open_ = size > 0
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x, seed * 1000 + i)
        offer = (h >> np.uint64(12)) | (np.uint64(i) << _ROUND_SHIFT)
        where = (mix(x, seed * 1000 + 500 + i) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, doc * t + where, offer)
        left = (out.reshape(sets, t) >> _ROUND_SHIFT == np.uint64(4095)).any(axis=1) & open_
        if not np.array_equal(left, open_):
            keep = left[doc]
            x, doc = x[keep], doc[keep]
            open_ = left
    return out.reshape(sets, t)


def bands(sketch: np.ndarray, rows: int, seed: int = 11) -> np.ndarray:
    """(sets, t // rows) one hash per band of ``rows`` coordinates; the band's number is part of it."""
    sets, t = sketch.shape
    out = np.empty((sets, t // rows), dtype=np.uint64)
    for b in range(t // rows):
        h = np.full(sets, seed * 4096 + b, dtype=np.uint64)
        for r in range(rows):
            h = mix(h ^ sketch[:, b * rows + r], r + 1)
        out[:, b] = h
    return out


def set_keys(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(sets, 2) order-free 128-bit identity of each set (sums of two mixings of its elements)."""
    out = np.zeros((len(ends) - 1, 2), dtype=np.uint64)
    some = np.flatnonzero(np.diff(ends) > 0)
    if len(some):
        for k in (0, 1):
            out[some, k] = np.add.reduceat(mix(flat, 900 + k), ends[:-1][some])
    return out
