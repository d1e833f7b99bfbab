"""Packed token-id matrices, written as binary.

Every input partition tokenises its documents, cuts those longer than a sequence
into pieces without losing an id, and packs the pieces of about ``shard_tokens`` ids
at a time by best-fit decreasing: the fullest sequence that still takes a piece
comes from a segment tree over free room.  A shard's sequences are rows of a
Parquet table:

* ``ids``: ``length`` little-endian unsigned numbers (16 bits where the vocabulary
  allows, else 32), free places at the end filled with ``pad_id``;
* ``cu_seqlens``: cumulative segment lengths, from 0 to the used places;
* ``resets``: places where position ids start again at 0;
* ``doc_id``, ``piece``, ``start``: which document part each segment is.

Shards are named by partition and number, so a task that runs twice writes the
same rows; Spark's committer keeps one of them.  Nothing is shuffled.

Defined cases: a null or empty text is the end id alone; equal rows are written
each; a null id stays null; an empty table writes no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .packing import RoomTree, best_fit_decreasing, pieces
from .textkit import chunks, utf8
from .tokens import WordTokenizer, ragged


@dataclass(frozen=True)
class BinaryParams:
    tokenizer: str
    length: int = 2048
    end_id: int = 0
    pad_id: int = 0
    shard_tokens: int = 4 << 20
    token_chunk: int = 8 << 20


ROW = ("shard string, row int, width int, ids binary, cu_seqlens array<int>, resets array<int>, doc_id array<long>, piece array<int>, start array<long>")
_ROW = pa.schema([("shard", pa.string()), ("row", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                  ("resets", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("piece", pa.list_(pa.int32())), ("start", pa.list_(pa.int64()))])
_ROWS = 512                      # rows of an output batch


def position_ids(cu_seqlens: np.ndarray, length: int) -> np.ndarray:
    """Position of every place in its segment; free places count on from 0."""
    edges = np.concatenate([cu_seqlens, [length]])
    return np.arange(length) - np.repeat(edges[:-1], np.diff(edges))


def _shard(p: BinaryParams, name: str, width: int, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray):
    """Rows of one shard, in batches."""
    doc, piece, start, size, _ = pieces(ends, ids, p.length)
    bin_of, place, bins = best_fit_decreasing(size, p.length, RoomTree(p.length))
    order = np.lexsort((place, bin_of))
    doc, piece, start, size, bin_of, place = (x[order] for x in (doc, piece, start, size, bin_of, place))
    matrix = np.full((bins, p.length), p.pad_id, dtype=f"<u{width}")
    matrix.reshape(-1)[ragged(bin_of * p.length + place, size)] = ids[ragged(ends[:-1][doc] + start, size)]
    first = np.searchsorted(bin_of, np.arange(bins + 1))
    used = np.bincount(bin_of, weights=size, minlength=bins).astype(np.int32)
    names = doc_ids.take(pa.array(doc))
    for a in range(0, bins, _ROWS):
        b = min(a + _ROWS, bins)
        i, j = first[a], first[b]
        offsets = pa.array((first[a:b + 1] - i).astype(np.int32))
        ends_of_rows = first[a + 1:b + 1] - i
        cu = np.insert(place[i:j].astype(np.int32), ends_of_rows, used[a:b])
        cu_offsets = pa.array((first[a:b + 1] - i + np.arange(b - a + 1)).astype(np.int32))
        listed = lambda x: pa.ListArray.from_arrays(offsets, x)
        yield pa.RecordBatch.from_arrays([
            pa.array([name] * (b - a)), pa.array(np.arange(a, b, dtype=np.int32)), pa.array(np.full(b - a, width, dtype=np.int32)),
            pa.array([x.tobytes() for x in matrix[a:b]], pa.binary()), pa.ListArray.from_arrays(cu_offsets, pa.array(cu)),
            listed(pa.array(place[i:j].astype(np.int32))), listed(names.slice(i, j - i)), listed(pa.array(piece[i:j].astype(np.int32))), listed(pa.array(start[i:j]))],
            schema=_ROW)


def _write(p: BinaryParams):
    def run(batches):
        coder = WordTokenizer(p.tokenizer, p.end_id)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        partition, shard = TaskContext.get().partitionId(), 0
        names, ids, sizes, held = [], [], [], 0
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in chunks(off, p.token_chunk):
                x, ends = coder.encode(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                names.append(batch.column(0).slice(i, j - i))
                ids.append(x)
                sizes.append(np.diff(ends))
                held += len(x)
                if held >= p.shard_tokens:
                    yield from _shard(p, f"{partition:06d}-{shard:05d}", width, pa.concat_arrays(names), np.concatenate(ids),
                                      np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
                    names, ids, sizes, held, shard = [], [], [], 0, shard + 1
        if held:
            yield from _shard(p, f"{partition:06d}-{shard:05d}", width, pa.concat_arrays(names), np.concatenate(ids),
                              np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
    return run


def write_packed(docs: DataFrame, path: str, params: BinaryParams, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the packed matrices of ``docs`` under ``path``."""
    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
     .mapInArrow(_write(params), ROW).write.option("compression", "zstd").parquet(path))


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, shard string, row int, offset long"


def _read(batches):
    for b in batches:
        out = []
        for shard, row, width, ids, cu, doc, piece, start in zip(*(b.column(n).to_pylist() for n in (
                "shard", "row", "width", "ids", "cu_seqlens", "doc_id", "piece", "start"))):
            wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
            for k in range(len(doc)):
                out.append((doc[k], piece[k], start[k], cu[k + 1] - cu[k], zlib.crc32(wide[cu[k]:cu[k + 1]]), shard, row, cu[k]))
        if out:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in PIECE.split(", ")])


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every segment of the written matrices, its checksum taken from the stored ids (as 32-bit numbers)."""
    return (spark.read.schema(ROW).parquet(path)
            .select("shard", "row", "width", "ids", "cu_seqlens", "doc_id", "piece", "start").mapInArrow(_read, PIECE))


def packed_round_trip(docs: DataFrame, params: BinaryParams) -> DataFrame:
    """Write to a new folder under ``spark.checkpoint.dir`` and read back."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    write_packed(docs, path, params)
    return read_pieces(spark, path)
