"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Index: vectors are grouped into lists by their nearest centroid (k-means on a
bounded sample, ``sample`` rows in hash order) and turned by one random
orthogonal matrix.  After the turn any leading block of columns is a fair sample
of a distance, so while scanning column block by column block a candidate is
abandoned as soon as its partial distance, scaled up to all columns, exceeds the
query's current k-th distance by more than the error a hypothesis test allows
(``1 + epsilon / sqrt(columns seen)``).  Survivors are measured exactly, in
double precision, on the original vectors.

Work is dealt as (shard of lists) x (block of queries).  A shard holds whole lists up to
``shard_rows`` vectors, or a part of a longer list; a query goes to the shards of
its ``probe`` nearest lists, scans its nearest list there first and keeps its
threshold over the shard's lists.  Equal vectors are one index entry with its
``k + 1`` smallest ids: further copies cannot be among anybody's k nearest, so
a third of all rows being copies neither skews a shard nor lengthens a scan.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do null ids and vectors of another length than the
most frequent one; a candidate with the query's own id is skipped; repeated
query ids are searched once (their smallest vector); fewer candidates than k
are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


@dataclass(frozen=True)
class AnnParams:
    sample: int = 16_384          # vectors that k-means sees
    lists: int = 0                # 0: the square root of the distinct vectors, 4096 at most
    probe: float = 0.65           # share of the lists a query scans (unstructured vectors need many)
    columns: int = 16             # columns per block
    epsilon: float = 3.0          # of the hypothesis test
    shard_rows: int = 8192
    query_rows: int = 2048
    rounds: int = 12              # of k-means
    seed: int = 5


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, float32."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([_sq(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        total = np.zeros((len(c), x.shape[1]), dtype=np.float64)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assign(centroids: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vector"))
                near = np.concatenate([_sq(x[i:i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column("vector"), b.column("ids")], names=["list", "vector", "ids"])
    return run


def _probes(centroids: np.ndarray, probe: int, base: np.ndarray, span: np.ndarray):
    """One row per (query, shard): the probed lists of the shard, nearest first."""
    def run(batches):
        for b in batches:
            rows, lists, shards = [], [], []
            x = _matrix(b.column("vector"))
            for q in range(b.num_rows):
                near = np.argsort(_sq(x[q:q + 1], centroids)[0], kind="stable")[:probe]
                of: dict[int, list[int]] = {}
                for c in near.tolist():
                    for s in range(int(base[c]), int(base[c] + span[c])):
                        of.setdefault(s, []).append(c)
                for s, cs in of.items():
                    rows.append(q)
                    shards.append(s)
                    lists.append(cs)
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("query").take(take), b.column("vector").take(take), pa.array(shards, pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
                    names=["query", "vector", "shard", "lists"])
    return run


class Scan:
    """Adaptive scan of the lists of one shard for a block of queries."""

    def __init__(self, turned: np.ndarray, queries: np.ndarray, k: int, p: AnnParams):
        self.x, self.q, self.k, self.p = turned, queries, k, p
        self.limit = np.full(len(queries), np.inf, dtype=np.float32)      # squared k-th distance so far
        self.best = np.full((len(queries), k), np.inf, dtype=np.float32)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.steps = 0                                                    # column values looked at

    def _learn(self, qi: np.ndarray, xi: np.ndarray, d: np.ndarray) -> None:
        keep = d <= self.limit[qi] * np.float32(1.0001)
        qi, xi, d = qi[keep], xi[keep], d[keep]
        if not len(qi):
            return
        self.hits.append((qi, xi, d))
        order = np.lexsort((d, qi))
        qs, ds = qi[order], d[order]
        first = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]])
        rank = np.arange(len(qs)) - np.repeat(first, np.diff(np.r_[first, len(qs)]))
        top = rank < self.k
        who = qs[first]
        fresh = np.full((len(who), self.k), np.inf, dtype=np.float32)
        fresh[np.repeat(np.arange(len(who)), np.diff(np.r_[first, len(qs)]))[top], rank[top]] = ds[top]
        self.best[who] = np.sort(np.concatenate([self.best[who], fresh], axis=1), axis=1)[:, :self.k]
        self.limit[who] = self.best[who, -1]

    def run(self, qi: np.ndarray, a: int, b: int) -> None:
        """Queries ``qi`` against the vectors ``a:b``, in tiles."""
        dim, step = self.x.shape[1], self.p.columns
        for i in range(a, b, 1024):
            x = self.x[i:min(i + 1024, b)]
            open_ = np.isinf(self.limit[qi])
            if open_.any():                                  # no threshold yet: full distances
                who = qi[open_]
                d = _sq(self.q[who], x)
                self.steps += d.size * dim
                self._learn(np.repeat(who, len(x)), np.tile(np.arange(i, i + len(x)), len(who)), d.ravel())
            who = qi[~open_]
            if not len(who):
                continue
            part = _sq(self.q[who, :step], x[:, :step])
            self.steps += part.size * step
            rows, cols = np.nonzero(part <= self._bound(who, step)[:, None])
            d, seen = part[rows, cols], step
            rows = who[rows]
            while seen < dim and len(rows):
                to = min(seen + step, dim)
                gap = self.q[rows, seen:to] - x[cols, seen:to]
                self.steps += gap.size
                d = d + np.einsum("ij,ij->i", gap, gap)
                seen = to
                ok = d <= self._bound(rows, seen)
                rows, cols, d = rows[ok], cols[ok], d[ok]
            self._learn(rows, cols + i, d)

    def _bound(self, who: np.ndarray, seen: int) -> np.ndarray:
        dim = self.x.shape[1]
        slack = 1.0001 if seen >= dim else (1 + self.p.epsilon / math.sqrt(seen)) ** 2 * seen / dim
        return self.limit[who] * np.float32(slack)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) within each query's final limit."""
        if not self.hits:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        qi, xi, d = (np.concatenate(h) for h in zip(*self.hits))
        keep = d <= self.limit[qi] * np.float32(1.0001)
        return qi[keep], xi[keep]


_HITS = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])


def _scan(p: AnnParams, k: int, turn: np.ndarray):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _HITS.empty_table()
        vectors = vectors.sort_by("list")
        lists = vectors["list"].to_numpy()
        x, q = _matrix(vectors["vector"]), _matrix(queries["vector"])
        scan = Scan(x @ turn, q @ turn, k, p)
        names, starts = np.unique(lists, return_index=True)
        ends = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(lists)])))
        probed = [[c for c in cs if c in ends] for cs in queries["lists"].to_pylist()]
        near, rest = {}, {}
        for n, cs in enumerate(probed):
            for j, c in enumerate(cs):
                (rest if j else near).setdefault(c, []).append(n)
        for todo in (near, rest):
            for c, who in todo.items():
                scan.run(np.array(who), *ends[c])
        qi, xi = scan.result()
        exact = np.concatenate([np.sqrt(((q[qi[i:i + 65536]].astype(np.float64) - x[xi[i:i + 65536]].astype(np.float64)) ** 2).sum(axis=1))
                                for i in range(0, len(qi), 65536)]) if len(qi) else np.zeros(0)
        ids = vectors["ids"].combine_chunks()
        offsets, flat = np.asarray(ids.offsets), ids.flatten().to_numpy()
        offsets = offsets - offsets[0]
        n = np.diff(offsets)[xi]
        at = np.repeat(offsets[:-1][xi] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        qi, exact, vec = np.repeat(qi, n), np.repeat(exact, n), flat[at]
        order = np.lexsort((vec, exact, qi))
        qi, exact, vec = qi[order], exact[order], vec[order]
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, dtype=np.int64)
        top = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)])) < k
        name = queries["query"].to_numpy()
        return pa.table([name[qi[top]], exact[top], vec[top]], schema=_HITS)
    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part (see the module), vectors as float arrays of one length."""
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda v: v != 0))
    dim = x.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return x.filter(F.size("vector") == (dim["n"] if dim else 0))


def search(base: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           params: AnnParams = AnnParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row with ``is_query``, among all other ids."""
    p = params
    spark = base.sparkSession
    ensure_checkpoint_dir(spark)
    rows = usable(base, id_col, vector_col)
    copy = Window.partitionBy("vector").orderBy("id")
    entries = (rows.withColumn("n", F.row_number().over(copy)).filter(F.col("n") <= k + 1)
               .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))).checkpoint()
    count = entries.count()
    wanted = rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector")).checkpoint()
    queries = wanted.groupBy("vector").agg(F.min("id").alias("query"))
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r[0] for r in entries.orderBy(F.xxhash64("vector"), "ids").limit(p.sample).select("vector").collect()], dtype=np.float32)
    lists = min(p.lists or max(1, round(math.sqrt(count))), 4096, len(sample))
    centroids = kmeans(sample, lists, p.rounds, p.seed)
    turn = rotation(sample.shape[1], p.seed)
    assigned = entries.mapInArrow(_assign(centroids), "list int, vector array<float>, ids array<long>").checkpoint()
    size = np.zeros(lists, dtype=np.int64)
    for r in assigned.groupBy("list").count().collect():               # one row per list, 4096 at most
        size[r["list"]] = r["count"]
    base_of, span, used, shard = np.zeros(lists, dtype=np.int64), np.ones(lists, dtype=np.int64), 0, 0
    for c in range(lists):
        if used and used + size[c] > p.shard_rows:
            shard, used = shard + 1, 0
        base_of[c], span[c] = shard, max(1, -(-size[c] // p.shard_rows))
        shard, used = shard + span[c] - 1, used + size[c] if span[c] == 1 else p.shard_rows
    shards = int(shard) + 1
    groups = max(1, -(-queries.count() // p.query_rows))
    at = lambda v: F.element_at(F.array(*[F.lit(int(i)) for i in v]), F.col("list") + 1)
    dealt = (assigned.withColumn("shard", (at(base_of) + F.pmod(F.xxhash64("vector"), at(span))).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    asked = (queries.mapInArrow(_probes(centroids, max(1, math.ceil(p.probe * lists)), base_of, span),
                                "query long, vector array<float>, shard int, lists array<int>")
             .withColumn("block", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")))
    hits = (dealt.select("shard", "block", "list", "vector", "ids").groupBy("shard", "block")
            .cogroup(asked.select("shard", "block", "query", "vector", "lists").groupBy("shard", "block"))
            .applyInArrow(_scan(p, k + 1, turn), "query long, score double, vec_id long"))
    near = Window.partitionBy("query").orderBy("score", "vec_id")
    found = hits.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    names = wanted.select(F.col("id").alias("query_id"), "vector").join(queries, "vector").select("query_id", "query")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (names.join(found, "query").filter("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(own).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
