"""Hash-seeded stratified splits, folds, learning-curve subsets, sampling
(WIN-5 ... WIN-7, SET-2, SMP-1, C6, C7).

Randomness is ``xxhash64(key, seed)``: the same rows land in the same split
whatever the partitioning or the executor that computes them (``rand`` and
``sample`` do not have that property, so a lost executor could reshuffle a
split).  Per-class positions come from hash buckets (``class_rank``): a class
of any size is spread over many tasks, with one shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import prefix_sums

BUCKET_ROWS = 1 << 17          # rows of a hash bucket, about
BUCKET_BITS = 16               # most leading hash bits that name a bucket


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n) per class, as a table: nothing depends on how many classes there are."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def allocate(sizes: DataFrame, label: str, draws: int, total: int, out: str = "quota") -> DataFrame:
    """Per-class share of ``draws`` proportional to ``n``; the remainder goes to
    the largest fractional parts (ties: class order).  The window runs over the
    per-class table, one row per class."""
    cont = F.col("n") * F.lit(draws) / F.lit(max(total, 1))
    base = F.floor(cont)
    part = sizes.withColumn("_base", base).withColumn("_frac", cont - base)
    need = F.lit(draws) - F.sum("_base").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.col("_frac").desc(), F.col(label).asc_nulls_first()))
    return part.withColumn(out, F.col("_base") + (order <= need).cast("long")).drop("_base", "_frac")


def class_rank(df: DataFrame, label: str, key: str, seed: int, per_class=None, out: str = "_crank") -> DataFrame:
    """0-based position of every key within its class in hash order, in place.

    The order is a hash, so its leading bits cut a class into even buckets:
    one narrow count per (class, bucket) gives the offsets, and a rank inside
    the bucket the rest -- one shuffle of the rows, no sampling, no checkpoint and
    no join on the key.  Rows that repeat a key (over-sampled copies) share
    its position, so they stay together.  ``per_class(sizes)`` may add columns to
    the per-class table (label, n = distinct keys); they arrive on the rows.
    """
    n = df.count()
    bits = min(BUCKET_BITS, max(0, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS))))
    h = hash_order(key, seed)
    bucket = F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)
    keys = df.select(F.col(label).alias("_label"), key).distinct().withColumn("_bucket", bucket)
    counts = keys.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    extra: list[str] = []
    if per_class is not None:
        sizes = per_class(counts.groupBy("_label").agg(F.sum("_n").alias("n")).withColumnRenamed("_label", label))
        extra = [c for c in sizes.columns if c not in (label, "n")]
        sizes = sizes.select(F.col(label).alias("_class"), *extra)
        offsets = offsets.join(sizes, F.col("_label").eqNullSafe(F.col("_class"))).drop("_class")
    offsets = offsets.drop("_n").withColumnRenamed("_bucket", "_at")
    inside = Window.partitionBy(label, "_bucket").orderBy("_h", key)
    ranked = df.withColumn("_h", h).withColumn("_bucket", bucket).withColumn("_rank", F.dense_rank().over(inside))
    joined = ranked.join(offsets, ranked[label].eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_at")))
    return joined.withColumn(out, F.col("_rank") - 1 + F.col("_offset")).select(*df.columns, out, *extra)


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42,
                     out: str = "is_test") -> DataFrame:
    """WIN-5: ``is_test`` with exact class shares (ceil(share * n) test keys).

    Copies of a key fall on the same side; shares are of distinct keys."""
    def quota(sizes: DataFrame) -> DataFrame:
        total = int(sizes.agg(F.sum("n")).first()[0] or 0)
        return allocate(sizes, label, math.ceil(test_share * total), total)
    ranked = class_rank(df, label, key, seed, quota)
    return ranked.withColumn(out, F.col("_crank") < F.col("quota")).drop("_crank", "quota")


def complement(df: DataFrame, flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """SET-2: (train, test) from the split flag; disjoint and complete."""
    return df.where(~F.col(flag)), df.where(F.col(flag))


def n_folds(df: DataFrame, label: str, key: str, k: int) -> int:
    """``k``, lowered to the distinct keys of the smallest class."""
    least = df.select(label, key).distinct().groupBy(label).count().agg(F.min("count")).first()[0]
    k = min(k, int(least)) if least is not None else k
    if k < 2:
        raise ValueError("stratified folds need at least 2 rows in every class")
    return k


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """WIN-6: per-class position by hash, ``% k``; k lowered to the smallest
    class size.  Fold sizes per class differ by at most one key."""
    kk = n_folds(df, label, key, k)
    ranked = class_rank(df, label, key, seed)
    return ranked.withColumn(out, (F.col("_crank") % kk).cast("int")).drop("_crank")


def learning_fractions(n: int = 15, lo: float = 0.1, hi: float = 1.0) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, n)]


def train_sizes(n_train: int, fractions: list[float]) -> list[int]:
    sizes = sorted({min(max(int(f * n_train), 1), n_train) for f in fractions})
    return sizes


def learning_ranks(df: DataFrame, key: str, fold: str = "fold", k: int = 5,
                   fractions: list[float] | None = None, out: str = "sizes") -> tuple[DataFrame, int]:
    """(key, fold, ``out``) and the number of sizes: for every split (validation
    fold ``s``) element ``s`` of ``out`` is the smallest size index whose prefix (in key
    order) of the training rows contains the row; null for its validation rows."""
    fractions = fractions or learning_fractions()
    ind = [f"_in{f}" for f in range(k)]
    base = df.select(key, fold, *[(F.col(fold) == f).cast("long").alias(c) for f, c in enumerate(ind)],
                     F.lit(1).cast("long").alias("_one"))
    pre = prefix_sums(base, [F.col(key)], ["_one", *ind])
    fold_sizes = {r[fold]: int(r["count"]) for r in df.groupBy(fold).count().collect()}
    total = sum(fold_sizes.values())
    per_split, most = [], 0
    for s in range(k):
        n_train = total - fold_sizes.get(s, 0)
        sizes = train_sizes(n_train, fractions)
        most = max(most, len(sizes))
        rank = F.col("cum__one") - F.col(f"cum__in{s}")          # 1-based position among training rows
        idx = F.lit(None).cast("int")
        for i in reversed(range(len(sizes))):
            idx = F.when(rank <= F.lit(sizes[i]), F.lit(i)).otherwise(idx)
        per_split.append(F.when(F.col(fold) != s, idx))
    return pre.select(key, fold, F.array(*per_split).alias(out)), most


def learning_subsets(df: DataFrame, key: str, fold: str = "fold", k: int = 5,
                     fractions: list[float] | None = None) -> DataFrame:
    """WIN-7 as rows: one per (row, split) with ``size_idx`` = the smallest size
    index containing the row; the subset for size i is ``size_idx <= i`` (nested)."""
    ranks, _ = learning_ranks(df, key, fold, k, fractions)
    return (ranks.select(key, fold, F.posexplode("sizes").alias("split", "size_idx"))
            .where(F.col("split") != F.col(fold)))


SAMPLE_BITS = 12               # leading hash bits counted at a time


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """SMP-1: the n rows that come first by (hash of the key, key); all rows when fewer.  A sampling operator, so the limit
    is the feature.

    No sort: a histogram of the leading bits of the hash (4,096 counts at most) names the bucket in which the n-th row
    lies, a second one cuts that bucket again, and so on; rows below the cut pass a filter.  Only the rows of the last
    bucket, which share all bits counted, are ranked.  Rows that repeat a key are taken in no stated order."""
    if n <= 0:
        return df.limit(0)
    h = hash_order(key, seed)
    ordered = (F.shiftright(h, 1) + F.lit(1 << 62)).cast("long")          # 0 to 2**63 - 1, in the order of the hash but for its last bit
    lo, width, below = 0, 63, 0                                           # the open range lo ... lo + 2**width - 1 and the rows before it
    last = None
    while width > 0:
        step = min(SAMPLE_BITS, width)
        cut = F.shiftright(ordered - F.lit(lo), width - step)
        inside = df if width == 63 else df.where(ordered.between(lo, lo + (1 << width) - 1))
        counts = {r["_b"]: r["count"] for r in inside.select(cut.cast("int").alias("_b")).groupBy("_b").count().collect()}
        if below + sum(counts.values()) <= n and width == 63:
            return df
        for b in sorted(counts):
            if below + counts[b] >= n:
                break
            below += counts[b]
        lo, width, last = lo + (b << (width - step)), width - step, counts[b]
        if below + last == n or last <= (1 << SAMPLE_BITS):
            break
    before = df.where(ordered < lo)
    edge = df.where(ordered.between(lo, lo + (1 << width) - 1))
    if below + last > n:
        edge = edge.orderBy(h, F.col(key)).limit(n - below)
    return before.unionByName(edge)
