"""Best fit of items into sequences of a fixed length, and the cutting of documents into pieces."""

from __future__ import annotations

import zlib

import numpy as np


def pieces(ends: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cut every document (``ids[ends[d]:ends[d + 1]]``) into pieces of ``length`` ids, its last one maybe shorter.

    Gives (document, piece number, start in the document, size, CRC-32 of the
    ids as little-endian 32-bit numbers).
    """
    size = np.diff(ends)
    count = -(-size // length)
    doc = np.repeat(np.arange(len(size)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * length
    part = np.minimum(size[doc] - start, length)
    data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    at = ((ends[:-1][doc] + start) * 4).tolist()
    crc = np.fromiter((zlib.crc32(data[a:a + n]) for a, n in zip(at, (part * 4).tolist())), dtype=np.int64, count=len(doc))
    return doc, piece, start, part, crc


class FreeBins:
    """Open bins by free room; the tightest room that still takes an item is one step on a bit set."""

    def __init__(self):
        self.rooms = 0
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        if room:
            self.bins.setdefault(room, []).append(number)
            self.rooms |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room of at least ``size``, taken out; None: no bin has it."""
        left = self.rooms >> size
        if not left:
            return None
        room = size + (left & -left).bit_length() - 1
        stack = self.bins[room]
        number = stack.pop()
        if not stack:
            self.rooms &= ~(1 << room)
        return room, number


class RoomTree:
    """The same question answered by a segment tree over room 0..length that counts open bins."""

    def __init__(self, length: int):
        self.leaves = 1
        while self.leaves <= length:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def add(self, room: int, number: int) -> None:
        if room:
            self.bins[room].append(number)
            self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        count, k = self.count, size + self.leaves
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):      # up to the first subtree to the right with a bin
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:                            # down to its smallest room
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        number = self.bins[room].pop()
        self._change(room, -1)
        return room, number


def best_fit_decreasing(sizes: np.ndarray, length: int, rooms=None) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, place in the bin, number of bins); items in order of falling size, equal sizes as they come."""
    rooms = rooms or FreeBins()
    order = np.argsort(-sizes, kind="stable")
    bin_of = np.empty(len(sizes), dtype=np.int64)
    place = np.empty(len(sizes), dtype=np.int64)
    bins = 0
    for k, size in zip(order.tolist(), sizes[order].tolist()):
        got = rooms.take(size)
        if got is None:
            room, number = length, bins
            bins += 1
        else:
            room, number = got
        bin_of[k] = number
        place[k] = length - room
        rooms.add(room - size, number)
    return bin_of, place, bins
