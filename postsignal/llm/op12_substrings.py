"""Substring removal: words covered by a passage of ``window`` words that occurs elsewhere too.

Method: difference-cover anchors.  ``D`` is a set of residues modulo ``period``
such that every residue is a difference of two of its members.  So for any two
word places ``i`` and ``j`` some ``d < period`` puts both ``i + d`` and ``j + d``
on cover places, and two equal windows at ``i`` and ``j`` share an anchor (the
``window - period + 1`` words from there) at the same distance ``d`` from their
starts.  Only cover places are hashed (5 of 21):

1. every block of documents gives its distinct anchors; a shuffle by anchor hash
   and one pass over the sorted rows finds those that occur twice or more;
2. they return to their blocks, where each is extended by ``d`` words to the left
   and ``period - 1 - d`` to the right for every ``d``: these are the only windows
   that can occur twice.  Their 96-bit hashes meet in a second shuffle;
3. repeated windows return to their blocks, which drop the words they cover.

Documents travel as compressed blocks, kept by a checkpoint and dealt twice; else
only hashes move.  A block sends a hash once,
however often it holds it, so a passage that a third of all documents share
costs a row per block and anchor; no pairs are formed.

Defined cases: a word is a run outside ``0x20`` and ``0x09``-``0x0D``, case kept;
null texts have no words; a document is a row, so rows that repeat an id or a text
are further occurrences; a window that repeats inside its own document counts
(overlapping ones too); documents shorter than the window keep all words; a null
id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .textkit import Words, chunks, mix, utf8


@dataclass(frozen=True)
class RepeatParams:
    window: int = 35              # words
    period: int = 21              # of the difference cover
    block_bytes: int = 4 << 20    # text of a block (one longer document excepted)


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues modulo ``period``."""
    if period < 3:
        return tuple(range(max(period, 1)))
    size = 2
    while True:
        for rest in combinations(range(2, period), size - 2):
            d = (0, 1, *rest)
            if len({(a - b) % period for a in d for b in d}) == period:
                return d
        size += 1


_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)


def run_hashes(h: np.ndarray, n: int, base: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from every place on that has so many; runs of doubled length are put together."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    b = _BASES[base]
    out, have, power, size = None, 0, h, 1            # power: hashes of runs of ``size`` words
    left = n
    while left:
        if left & 1:
            if out is None:
                out = power
            else:
                m = len(h) - (have + size) + 1
                out = out[:m] * np.uint64(pow(b, size, 1 << 64)) + power[have:have + m]
            have += size
        left >>= 1
        if left:
            m = len(power) - size
            power = power[:m] * np.uint64(pow(b, size, 1 << 64)) + power[size:size + m]
            size *= 2
    return mix(out[:len(h) - n + 1], 300 + base)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Word places from which ``n`` words lie in one document."""
    out = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    size = np.diff(first)
    long = size >= n
    np.add.at(out, first[:-1][long], 1)
    np.add.at(out, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(out[:-1]) > 0)


def cover_places(first: np.ndarray, p: RepeatParams) -> np.ndarray:
    """Places of anchors: on the cover, counted from the document's start, in documents that have a window."""
    size = np.diff(first)
    at = inside(np.concatenate([[0], np.cumsum(np.where(size >= p.window, size, 0))]), p.window - p.period + 1)
    start = first[:-1][size >= p.window]
    kept = size[size >= p.window]
    if not len(kept):
        return at
    own = np.cumsum(kept) - kept                       # place of each long document among the long ones
    doc = np.searchsorted(own, at, side="right") - 1
    place = at - own[doc]
    on = np.isin(np.arange(p.period), difference_cover(p.period))[place % p.period]
    return (start[doc] + place)[on]


# ---- blocks

BLOCK = "block long, ids array<long>, ends binary, text binary"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("text", pa.binary())])


def _blocks(p: RepeatParams):
    def run(batches):
        codec, n = pa.Codec("zstd", compression_level=9), 0
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in chunks(off, p.block_bytes):
                yield pa.RecordBatch.from_arrays([
                    pa.array([part + n]), pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    pa.array([(off[i:j + 1] - off[i]).tobytes()], pa.binary()),
                    pa.array([codec.compress(np.ascontiguousarray(buf[off[i]:off[j]]), asbytes=True)], pa.binary())], schema=_BLOCK)
                n += 1
    return run


class Block:
    """A block's text and words, unpacked."""

    def __init__(self, ids: pa.Scalar, ends: pa.Scalar, text: pa.Scalar):
        self.ids = ids.values
        self.off = np.frombuffer(ends.as_buffer(), dtype=np.int64)
        self.buf = np.frombuffer(pa.Codec("zstd").decompress(text.as_buffer(), int(self.off[-1])), dtype=np.uint8) if self.off[-1] else np.zeros(0, np.uint8)
        self.words = Words(self.buf, self.off, fold=False)


# ---- rows (hash, check, place): a block's distinct hashes; place: twice the block, plus 1 if the block has it twice or more

HASHES = "hash long, check int, place long"
_HASHES = pa.schema([("hash", pa.int64()), ("check", pa.int32()), ("place", pa.int64())])
_OUT = 200_000


def _once(h: np.ndarray, check: np.ndarray, block: int):
    """A block's distinct (hash, check), in batches."""
    order = np.argsort(h)
    h, check = h[order], check[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])]) if len(h) else np.zeros(0, dtype=np.int64)
    place = 2 * block + (np.diff(np.r_[start, len(h)]) > 1)
    h, check = h[start].view(np.int64), check[start]
    for i in range(0, len(h), _OUT):
        yield pa.RecordBatch.from_arrays([pa.array(h[i:i + _OUT]), pa.array(check[i:i + _OUT]), pa.array(place[i:i + _OUT])], schema=_HASHES)


def _anchors(p: RepeatParams):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                w = Block(batch["ids"][k], batch["ends"][k], batch["text"][k]).words
                at = cover_places(w.first, p)
                if len(at):
                    h = run_hashes(w.hash, p.window - p.period + 1)[at]
                    yield from _once(h, np.zeros(len(h), dtype=np.int32), batch["block"][k].as_py())
    return run


def _windows(p: RepeatParams):
    """Windows around the repeated anchors of a block."""
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        if not blocks.num_rows or not found.num_rows:
            return _HASHES.empty_table()
        w = Block(blocks["ids"][0], blocks["ends"][0], blocks["text"][0]).words
        known = np.sort(found["hash"].to_numpy().view(np.uint64))
        at = cover_places(w.first, p)
        h = run_hashes(w.hash, p.window - p.period + 1)[at]
        at = at[_in(h, known)]
        flag = np.zeros(len(w) + p.period + 1, dtype=np.int32)
        flag[at + 1] = 1
        np.cumsum(flag, out=flag)
        i = inside(w.first, p.window)
        i = i[flag[i + p.period] > flag[i]]                # an anchor among the first ``period`` places
        check = (run_hashes(mix(w.hash, 41), p.window, 1)[i] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        out = list(_once(run_hashes(w.hash, p.window)[i], check, blocks["block"][0].as_py()))
        return pa.Table.from_batches(out, schema=_HASHES)
    return run


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), dtype=bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _repeated(batches):
    """Rows whose (hash, check) occurs twice or more, from rows sorted by it.  One row is held between batches."""
    held = None                 # a last row that may go on in the next batch: (row, is it known as repeated)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, b = (np.asarray(batch.column(k)) for k in range(3))
        lead = held is not None
        if lead:
            h, c, b = (np.concatenate([[x], y]) for x, y in zip(held[0], (h, c, b)))
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(h)])
        hit = (size > 1) | np.logical_or.reduceat(b & 1 == 1, start)
        if lead:
            hit[0] |= held[1]
        keep = np.repeat(hit, size)
        if lead and held[1]:
            keep[0] = False                                # has gone out already
        last = bool(hit[-1])
        if not last:
            keep[-1] = False
        held = ((h[-1], c[-1], b[-1]), last)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(b[keep] >> 1), pa.array(h[keep])], names=["block", "hash"])


def repeated(hashes: DataFrame) -> DataFrame:
    """(block, hash) of the hashes that occur twice or more in all blocks together."""
    return hashes.repartition("hash").sortWithinPartitions("hash", "check").mapInArrow(_repeated, "block long, hash long")


# ---- the result

KEPT = "id long, n_words long, n_removed long, kept string"
_KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _removal(p: RepeatParams):
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for k in range(blocks.num_rows):
            x = Block(blocks["ids"][k], blocks["ends"][k], blocks["text"][k])
            w = x.words
            gone = np.zeros(len(w), dtype=bool)
            if found.num_rows:
                i = inside(w.first, p.window)
                i = i[_in(run_hashes(w.hash, p.window)[i], np.sort(found["hash"].to_numpy().view(np.uint64)))]
                edge = np.zeros(len(w) + 1, dtype=np.int32)
                np.add.at(edge, i, 1)
                np.add.at(edge, i + p.window, -1)
                gone = np.cumsum(edge[:-1]) > 0
            out.append(_cut(x, gone))
        return pa.concat_tables(out) if out else _KEPT.empty_table()
    return run


def _cut(x: Block, gone: np.ndarray) -> pa.Table:
    """The documents of a block without the words ``gone``, a space between the others."""
    w, docs = x.words, len(x.off) - 1
    words = np.diff(w.first)
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
    left = np.flatnonzero(~gone)
    final = np.zeros(len(w), dtype=bool)                   # a document's last word that stays has no space after it
    if len(left):
        final[left[np.r_[w.doc[left][1:] != w.doc[left][:-1], True]]] = True
    keep = np.zeros(len(x.buf) + 1, dtype=np.int8)
    np.add.at(keep, w.start[left], 1)
    np.add.at(keep, w.end[left], -1)
    byte = np.cumsum(keep[:-1], dtype=np.int8) > 0
    gap = w.end[left[~final[left]]]                        # another word follows, so white space stands here
    buf = x.buf.copy()
    buf[gap] = 0x20
    byte[gap] = True
    size = np.add.reduceat(np.r_[byte, False].astype(np.int64), x.off[:-1]) * (np.diff(x.off) > 0) if docs else np.zeros(0, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    text = pa.StringArray.from_buffers(docs, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buf[byte]))
    return pa.table([x.ids, pa.array(words), pa.array(lost.astype(np.int64)), text], schema=_KEPT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """(id, n_words, n_removed, kept): every document and its words outside repeated passages, joined by one space."""
    p = params
    ensure_checkpoint_dir(docs.sparkSession)
    blocks = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
              .mapInArrow(_blocks(p), BLOCK).checkpoint())
    anchors = repeated(blocks.mapInArrow(_anchors(p), HASHES))
    both = lambda found: blocks.groupBy("block").cogroup(found.groupBy("block"))
    windows = repeated(both(anchors).applyInArrow(_windows(p), HASHES))
    return both(windows).applyInArrow(_removal(p), KEPT)
