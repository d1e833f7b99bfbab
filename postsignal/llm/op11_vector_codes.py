"""Vector code compression: product codes from exact k-means over anchors-hierarchy trees.

Components become whole numbers, ``floor(scale * x)``, and a vector is cut into
``parts`` equal parts, each with a codebook of its own.  Every task groups its
vectors by ``chunk`` and builds a metric tree per part (``balls``); the forest is
written once (a checkpoint) and serves all rounds.  A round walks each tree
from the top with the list of entries that may be nearest to a point of the ball:
the list shrinks on the way down, and a ball that one entry owns gives its
cached sum and number without its points being looked at.  Tasks send their sums
per entry; the driver holds the codebooks only (``parts * entries`` rows).

All arithmetic that decides a result is on whole numbers, so codes, errors and
codebooks do not depend on the partitioning.

Defined cases: rows whose vector is null, empty, holds null or non-finite
components, or has another length than the most frequent one (the shorter of two)
are dropped; a length that ``parts`` does not divide is filled with zeros; whole
components are held within ``+-2**bits`` (27 for 64 components: values up to
524,288), so that errors fit a long; equal rows get a row each; the first codebook
takes each of the smallest ids once (the smallest vector of a repeated id) and
has fewer entries if there are fewer ids; null ids are coded but start no entry
(without any other id there is no codebook: empty codes, null errors); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .balls import Assignment, BallTree
from .intvectors import floors, matrix, with_vectors


@dataclass(frozen=True)
class CodeParams:
    parts: int = 16
    entries: int = 64             # of a codebook, 256 at most
    rounds: int = 2
    scale: int = 256
    chunk: int = 16_384           # vectors of a tree
    leaf: int = 24                # points of a ball that is not divided


@dataclass(frozen=True)
class VectorCodes:
    codebooks: list               # parts x entries x width, whole numbers
    rows: DataFrame               # id, label, code, error

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()


def _whole(x: np.ndarray, p: CodeParams) -> np.ndarray:
    """(rows, parts, width) whole numbers, filled up with zeros."""
    bits = (61 - math.ceil(math.log2(max(x.shape[1], 1)))) // 2
    n = floors(x, p.scale, bits)
    fill = -n.shape[1] % p.parts
    return np.pad(n, ((0, 0), (0, fill))).reshape(len(n), p.parts, -1)


def _plant(p: CodeParams, label_type):
    """Trees over chunks of a partition: one row a chunk."""
    def rows(ids, labels, x):
        n = _whole(np.concatenate(x), p)
        trees = [BallTree(np.ascontiguousarray(n[:, k]), p.leaf).dump() for k in range(p.parts)]
        return pa.RecordBatch.from_arrays([
            pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([pa.concat_arrays(labels).to_pylist()], pa.list_(label_type)),
            pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    def run(batches):
        ids, labels, x, held = [], [], [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                cut = b.slice(at, p.chunk - held)
                ids.append(cut.column(0))
                labels.append(cut.column(1))
                x.append(matrix(cut.column(2)))
                at, held = at + cut.num_rows, held + cut.num_rows
                if held == p.chunk:
                    yield rows(ids, labels, x)
                    ids, labels, x, held = [], [], [], 0
        if held:
            yield rows(ids, labels, x)
    return run


def _sums(books: np.ndarray):
    """Number and sum of every entry's points in a partition."""
    parts, entries, width = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for b in batches:
            for trees in b.column(0):
                for k, data in enumerate(trees.values):
                    a = Assignment(BallTree.load(data.as_py()), books[k])
                    count[k] += a.count
                    total[k] += a.total
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
                                              pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])
    return run


def _codes(books: np.ndarray, label_type):
    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                ids, labels = b.column(0)[row].values, b.column(1)[row].values
                code, error = np.zeros((len(ids), len(books)), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for k, data in enumerate(b.column(2)[row].values):
                    t = BallTree.load(data.as_py())
                    a = Assignment(t, books[k]).code
                    gap = t.points - books[k][a]
                    error[t.place] += (gap * gap).sum(1)
                    code[t.place, k] = a
                text = code.tobytes().hex()
                wide = 2 * len(books)
                yield pa.RecordBatch.from_arrays([ids, labels.cast(label_type), pa.array([text[i:i + wide] for i in range(0, len(text), wide)], pa.string()), pa.array(error)],
                                                 names=["id", "label", "code", "error"])
    return run


def _first_books(rows: DataFrame, p: CodeParams) -> np.ndarray:
    """The parts of the smallest ids' vectors; ``entries`` rows reach the driver."""
    least = rows.select("id").filter("id is not null").distinct().orderBy("id").limit(p.entries).collect()
    if not least:
        return np.zeros((p.parts, 0, 0), dtype=np.int64)
    first = rows.filter(F.col("id") <= least[-1]["id"]).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    return np.ascontiguousarray(_whole(np.array([r["vector"] for r in first], dtype=np.float64), p).transpose(1, 0, 2))


def compress(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", params: CodeParams = CodeParams()) -> VectorCodes:
    """Codes and squared errors of all usable vectors, after ``rounds`` rounds of k-means per part."""
    p = params
    if not 1 <= p.entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    ensure_checkpoint_dir(rows.sparkSession)
    kept, _ = with_vectors(rows, id_col, label_col, vector_col)
    label = kept.schema["label"].dataType
    schema = f"id long, label {label.simpleString()}, code string, error long"
    books = _first_books(kept, p)
    if not books.shape[1]:
        return VectorCodes([[] for _ in range(p.parts)], kept.select("id", "label", F.lit("").alias("code"), F.lit(None).cast("long").alias("error")))
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(label)
    forest = kept.mapInArrow(_plant(p, arrow), f"ids array<long>, labels array<{label.simpleString()}>, trees array<binary>").checkpoint()
    for _ in range(p.rounds):
        found = (forest.select("trees").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>").groupBy("part", "entry")
                 .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(books.shape[2])]).alias("total")).collect())
        books = books.copy()
        for r in found:                                        # at most parts * entries rows
            books[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return VectorCodes(books.tolist(), forest.mapInArrow(_codes(books, arrow), schema))


HOT_SHARE = 1000                  # labels with a thousandth of all rows or more: at most so many


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over equal labels (nulls together).

    Totals of frequent labels, at most ``HOT_SHARE`` of them, are broadcast; rows of
    the other labels meet theirs by a shuffle, where no label has many rows.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()
    count = rows.count()
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")).withColumnRenamed("label", "_label")
    hot = F.broadcast(totals.filter(F.col("_n") * HOT_SHARE >= count).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, rows["label"].eqNullSafe(hot["_label"]), "left").drop("_label", "_n")
    often = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot is null").drop("_hot", "label_error")
    cold = totals.filter(F.col("_n") * HOT_SHARE < count).drop("_n")
    return often.unionByName(rest.join(cold, rest["label"].eqNullSafe(cold["_label"])).drop("_label").select(*often.columns))
