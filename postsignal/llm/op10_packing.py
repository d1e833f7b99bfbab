"""Best-fit packing by hierarchical residual rounds.

Documents are tokenised, closed by an end id and cut only where longer than a
sequence.  Round 0 packs every input partition by best fit (falling sizes).
Sequences with at most ``slack`` free places are done and leave; the others go
on as items, whole, to a round with ``fan_in`` times fewer partitions, and so on
up the tree.  Rounds end when one partition has seen all leftovers, or when no
task's share of leftovers would exceed ``items`` and a round saves under one
percent of them.  Only leftover sequences are shuffled, as (piece list, size);
no text or token crosses the network, and a task holds at most its share.

Defined cases: a null or empty text is the end id alone; equal rows are packed
each; a null id stays null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .packing import best_fit_decreasing, pieces
from .textkit import chunks, utf8
from .tokens import WordTokenizer, ragged

MEMBER = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    length: int = 2048
    end_id: int = 0
    slack: int = 8             # a sequence with at most so many free places is done
    fan_in: int = 8
    items: int = 200_000       # leftover sequences a task of a later round takes
    token_chunk: int = 2 << 20


def _cut(p: PackParams):
    def run(batches):
        coder = WordTokenizer(p.tokenizer, p.end_id)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in chunks(off, p.token_chunk):
                ids, ends = coder.encode(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                doc, piece, start, size, crc = pieces(ends, ids, p.length)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc)],
                    names=[n for n, _ in _MEMBER])
    return run


def document_pieces(docs: DataFrame, params: PackParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(params), MEMBER)


def _pack(p: PackParams):
    """Items (size, members: list of pieces) of a partition into sequences; members keep the order of their places."""
    def run(batches):
        size, count, parts = [], [], []
        for batch in batches:
            members = batch.column(1)
            size.append(batch.column(0).to_numpy())
            count.append(np.diff(np.asarray(members.offsets)))
            parts.append(pa.RecordBatch.from_struct_array(members.flatten()))
        if not size:
            return
        size, count = np.concatenate(size), np.concatenate(count).astype(np.int64)
        flat = pa.Table.from_batches(parts).combine_chunks()
        bin_of, place, bins = best_fit_decreasing(size, p.length)
        order = np.lexsort((place, bin_of))
        rows = pa.array(ragged((np.cumsum(count) - count)[order], count[order]))
        used = np.bincount(bin_of, weights=size, minlength=bins).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(bin_of, weights=count, minlength=bins).astype(np.int64))])
        struct = flat.take(rows).to_struct_array().combine_chunks()
        for a in range(0, bins, 20_000):
            b = min(a + 20_000, bins)
            lists = pa.ListArray.from_arrays(pa.array((ends[a:b + 1] - ends[a]).astype(np.int32)), struct.slice(ends[a], ends[b] - ends[a]))
            yield pa.RecordBatch.from_arrays([pa.array(used[a:b]), lists], names=["size", "members"])
    return run


def pack(documents_pieces: DataFrame, params: PackParams) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset`` in it."""
    p = params
    ensure_checkpoint_dir(documents_pieces.sparkSession)
    schema = f"size long, members array<struct<{MEMBER.replace(' ', ': ')}>>".replace(",: ", ", ")
    items = documents_pieces.select(
        F.col("length").alias("size"),
        F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members"))
    width, done, full = 0, [], F.col("size") >= p.length - p.slack
    before = None
    while True:
        packed = items.mapInArrow(_pack(p), schema).checkpoint()
        left = packed.filter(~full).count()
        width = width or packed.rdd.getNumPartitions()
        settled = before is not None and left >= 0.99 * before
        if left == 0 or width == 1 or (settled and width * p.items >= left):
            done.append(packed)
            break
        done.append(packed.filter(full))
        width, before = max(1, -(-width // p.fan_in), -(-left // p.items)), left
        items = packed.filter(~full).repartition(width, F.xxhash64(F.element_at("members", 1)))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    piece = F.col("m")
    return (out.withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offsets", F.expr(
                "transform(members, (x, i) -> aggregate(slice(members, 1, i), cast(0 as bigint), (a, y) -> a + y.length))"))
            .select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), F.col("offsets").alias("o"))).alias("z"))
            .select(F.col("z.m").alias("m"), "sequence_id", F.col("z.o").alias("offset"))
            .select(*[piece[n].alias(n) for n, _ in _MEMBER], "sequence_id", "offset"))


def pack_documents(docs: DataFrame, params: PackParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(document_pieces(docs, params, id_col, text_col), params)
