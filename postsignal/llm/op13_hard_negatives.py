"""Hard negatives by inner product, from STR-packed R-trees.

Vectors become whole numbers, ``floor(scale * x)``; rows of one label with equal
vectors are one entry with its smallest ids (as many as an answer can need), so copies
cost nothing.  Entries are range-partitioned by label and leading coordinates and
packed into R-trees of at most ``shard_rows`` (``rtree``), written once by a
checkpoint.  Boxes of up to ``routes`` runs of shards route the anchors:

1. every anchor searches the run with the highest bound for its label and thereby
   gets a k-th score; then only the runs whose bound reaches that score;
2. with the positives known, it searches the runs whose interval meets one of the
   score windows.

A shard's task reads its tree, then the anchors sent to it as a stream of batches.
Each search walks the tree best bound first and leaves out boxes outside the
windows or strictly behind the k-th candidate (by score, then by id).  No
pair of rows is formed beyond the answers of each shard, at most k of a query.

Defined cases: rows with a null id, a null label, a null vector, null or non-finite
components, or a vector of another length than the most frequent one take no
part; rows that repeat id, label and vector count once, other rows that share an
id count each, but are no partners of that id's anchor, which takes the smallest
label and vector; whole components are held within ``+-2**bits`` (26 for 64
components: values up to 262,144); a positive score below 0 has an empty window;
an empty table, no anchors or one label give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .intvectors import matrix, with_vectors
from .rtree import RTree, Searcher, intervals


@dataclass(frozen=True)
class MineParams:
    positives: int = 5
    negatives: int = 5
    share: int = 80               # a negative scores at least so many hundredths of the positive, and no more than it
    scale: int = 256
    shard_rows: int = 8192
    leaf: int = 64
    fan: int = 16
    routes: int = 4096            # boxes that every task gets


TREE = "shard long, label_low long, label_high long, low array<int>, high array<int>, tree binary"
_TREE = pa.schema([("shard", pa.int64()), ("label_low", pa.int64()), ("label_high", pa.int64()), ("low", pa.list_(pa.int32())),
                   ("high", pa.list_(pa.int32())), ("tree", pa.binary())])


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy() for v in column]


def _pack(p: MineParams):
    """A partition's entries as R-trees of at most ``shard_rows``."""
    def tree(label, x, ids, shard):
        t = RTree(np.concatenate(x), np.concatenate(label), [i for part in ids for i in part], p.leaf, p.fan)
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([t.label_low[-1]]), pa.array([t.label_high[-1]]), pa.array([t.low[-1].tolist()], pa.list_(pa.int32())),
                                           pa.array([t.high[-1].tolist()], pa.list_(pa.int32())), pa.array([t.dump()], pa.binary())], schema=_TREE)

    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId() << 24
        label, x, ids, held = [], [], [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                cut = b.slice(at, p.shard_rows - held)
                label.append(cut.column(0).to_numpy())
                x.append(matrix(cut.column(1)))
                ids.append(_lists(cut.column(2)))
                at, held = at + cut.num_rows, held + cut.num_rows
                if held == p.shard_rows:
                    yield tree(label, x, ids, shard)
                    label, x, ids, held, shard = [], [], [], 0, shard + 1
        if held:
            yield tree(label, x, ids, shard)
    return run


ASK = "anchor long, label long, vector array<int>, bar_score long, bar_id long, windows array<long>"


def _route(boxes: list, mode: str, low_of):
    """Rows of ``ASK`` with the run of shards to ask: ``best``: that with the highest bound for the label; ``rest``: the others
    that reach the bar; ``windows``: those whose interval meets a window and that hold another label."""
    name = np.array([b["route"] for b in boxes])
    label_low, label_high = (np.array([b[c] for b in boxes]) for c in ("label_low", "label_high"))
    low, high = (np.array([b[c] for b in boxes], dtype=np.int64) for c in ("low", "high"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lab = b.column(1).to_numpy()
            least, most = intervals(matrix(b.column(2)).astype(np.int64), low, high)
            own = (label_low[None] <= lab[:, None]) & (lab[:, None] <= label_high[None])
            if mode != "windows":
                bound = np.where(own, most, np.iinfo(np.int64).min)
                best = np.zeros_like(own)
                best[np.arange(len(lab)), bound.argmax(1)] = True
                if mode == "best":
                    ask = best
                else:
                    bar = b.column(3).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                    ask = own & ~best & (most >= bar[:, None])
            else:
                other = ~((label_low == label_high)[None] & (label_low[None] == lab[:, None]))
                ask = np.zeros_like(own)
                for k, w in enumerate(b.column(5)):
                    for top in w.as_py() or []:
                        ask[k] |= other[k] & (most[k] >= low_of(top)) & (least[k] <= top)
            row, run_ = np.nonzero(ask)
            if len(row):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(row)) for c in b.columns] + [pa.array(name[run_])], names=[*b.schema.names, "route"])
    return run


HIT = "anchor long, top long, score long, id long"
_HIT = pa.schema([("anchor", pa.int64()), ("top", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def _search(p: MineParams, low_of, negative: bool):
    """Per shard: its tree's row, then the questions to it."""
    def answers(tree: RTree, ask: pa.RecordBatch):
        s = Searcher(tree, matrix(ask["vector"]).astype(np.int64))
        out = []
        for n, (anchor, label) in enumerate(zip(ask["anchor"].to_pylist(), ask["label"].to_pylist())):
            if negative:
                tops = ask["windows"][n].as_py()
                for top, found in zip(tops, s.negatives(n, label, [(low_of(t), t) for t in tops], p.negatives)):
                    out += [(anchor, top, -f, i) for f, i in found]
            else:
                bar = ask["bar_score"][n].as_py()
                floor = None if bar is None else (-bar, ask["bar_id"][n].as_py())
                out += [(anchor, None, -f, i) for f, i in s.positives(n, label, anchor, p.positives, floor)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_HIT) if out else None

    def run(batches):
        tree, shard = None, None
        for b in batches:
            at = b["shard"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
            for i, j in zip(cuts, [*cuts[1:], len(at)]):
                part = b.slice(int(i), int(j - i))
                if shard != at[i]:
                    tree, shard = None, at[i]
                if part["kind"][0].as_py() == 0:                 # sorted: the tree comes before the questions
                    tree = part["tree"][0].as_py()
                    part = part.slice(1)
                if part.num_rows:
                    if isinstance(tree, bytes):
                        tree = RTree.load(tree)
                    got = answers(tree, part)
                    if got is not None:
                        yield got
    return run


def _ask(forest: DataFrame, shards: int, asked: DataFrame, p: MineParams, low_of, negative: bool) -> DataFrame:
    """Answers of the shards to the questions dealt to their runs."""
    questions = forest.select("route", "shard").join(asked, "route").select("shard", F.lit(1).alias("kind"), *[c.split()[0] for c in ASK.split(", ")], F.lit(None).cast("binary").alias("tree"))
    trees = forest.select("shard", F.lit(0).alias("kind"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ASK.split(", ")], "tree")
    return (trees.unionByName(questions).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(p, low_of, negative), HIT))


def _first(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def entries(rows: DataFrame, dim: int, p: MineParams) -> tuple[DataFrame, DataFrame]:
    """((label, vector, ids): the smallest ids of equal rows; (id, label, vector) of distinct rows, whole numbers)."""
    bits = (59 - math.ceil(math.log2(max(dim, 1)))) // 2
    limit = float(1 << bits)
    whole = F.transform("vector", lambda v: F.floor(F.least(F.greatest(v * p.scale, F.lit(-limit)), F.lit(limit))).cast("int"))
    one = rows.select("id", F.col("label").cast("long").alias("label"), whole.alias("vector")).distinct()
    need = max(p.positives + 1, p.negatives)
    copy = Window.partitionBy("label", "vector").orderBy("id")
    few = one.withColumn("n", F.row_number().over(copy)).filter(F.col("n") <= need)
    return few.groupBy("label", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), one


def mine(rows: DataFrame, is_anchor, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         params: MineParams = MineParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row with ``is_anchor(id)``."""
    p = params
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    kept, dim = with_vectors(rows.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()), id_col, label_col, vector_col)
    share = p.share

    def low_of(top: int) -> int:
        """The least score of a window that ends at ``top``."""
        return -((-share * top) // 100)

    grouped, single = entries(kept, dim, p)
    index = grouped.checkpoint()
    count = index.count()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    shards = -(-count // p.shard_rows)
    lead = [F.col("vector")[i] for i in range(min(dim, 2))]
    forest = (index.repartitionByRange(shards, "label", *lead, F.xxhash64("vector")).select("label", "vector", "ids").mapInArrow(_pack(p), TREE).checkpoint())
    width = -(-forest.rdd.getNumPartitions() // p.routes)
    forest = forest.withColumn("route", F.expr(f"shiftright(shard, 24) div {width}"))
    boxes = [r.asDict() for r in forest.groupBy("route").agg(
        F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"), F.array(*[F.min(F.col("low")[i]) for i in range(dim)]).alias("low"),
        F.array(*[F.max(F.col("high")[i]) for i in range(dim)]).alias("high")).collect()]          # at most ``routes`` rows
    first = single.filter(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    anchors = first.select(F.col("id").alias("anchor"), "r.label", "r.vector", F.lit(None).cast("long").alias("bar_score"), F.lit(None).cast("long").alias("bar_id"),
                           F.lit(None).cast("array<long>").alias("windows")).checkpoint()

    def ask(questions: DataFrame, mode: str) -> DataFrame:
        asked = questions.mapInArrow(_route(boxes, mode, low_of), ASK + ", route long")
        return _ask(forest, shards, asked, p, low_of, mode == "windows")

    near = _first(ask(anchors, "best"), ["anchor"], p.positives).checkpoint()
    bar = near.filter(F.col("rank") == p.positives).select("anchor", F.col("score").alias("bar_score"), F.col("id").alias("bar_id"))
    more = ask(anchors.drop("bar_score", "bar_id").join(bar, "anchor", "left").select(*anchors.columns), "rest")
    positives = _first(near.select("anchor", "score", "id").unionByName(more.select("anchor", "score", "id")), ["anchor"], p.positives).checkpoint()
    tops = positives.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("windows"))
    hits = _first(ask(anchors.drop("windows").join(tops, "anchor").select(*anchors.columns), "windows"), ["anchor", "top"], p.negatives)
    return (positives.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            .join(hits.select(F.col("anchor").alias("anchor_id"), F.col("top").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
                              F.col("score").alias("negative_score")), ["anchor_id", "positive_score"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
