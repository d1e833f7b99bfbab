"""Exact global prefix sums and ranks without a single-task window (C2).

A ``Window.orderBy`` without ``partitionBy`` moves every row into one task.
Instead:

1. range-partition on (group, order) -- the range partitioner samples the
   keys, so a hot group is split across many partitions;
2. checkpoint, so the partition assignment is fixed for the two reads below
   (the sampled bounds could otherwise change on re-execution);
3. per (partition, group) totals -- at most ``P + G`` rows -- turned into
   offsets by a window over partitions of the same group;
4. running sums inside each (partition, group), plus the offset.

No data goes through the driver; the offset table is bounded by the number of
partitions plus groups, and Spark/AQE chooses how to join it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions

PID = "_pid"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def freeze(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def prefix_sums(df: DataFrame, order: list, values: list[str], groups: list[str] | None = None,
                prefix: str = "cum_", partitions: int | None = None, next_of: list[str] | None = None,
                first_of=None) -> DataFrame:
    """Add ``cum_<v>``: inclusive running sum of ``v`` in ``order`` within ``groups``.

    ``order`` must be a total order within a group (add a key to break ties).
    ``next_of``: columns of the following row to add as ``next_<c>`` (null after the
    last); ``first_of(struct)`` is the aggregate that finds a partition's first row.
    """
    groups = list(groups or [])
    order_cols = [_col(o) for o in order]
    n = partitions or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(g) for g in groups], *order_cols)
    ranged = freeze(ranged.withColumn(PID, F.spark_partition_id()))

    heads = [first_of(F.struct(*next_of)).alias("_head")] if next_of else []
    totals = ranged.groupBy(PID, *groups).agg(*[F.sum(v).alias(f"_t_{v}") for v in values], *heads)
    before = Window.partitionBy(*groups).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PID, *groups, *[
        F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *([F.lead("_head").over(Window.partitionBy(*groups).orderBy(PID)).alias("_after")] if next_of else []))

    running = Window.partitionBy(PID, *groups).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # null-safe on the groups: rows of a null group keep their place
    offsets = offsets.select(F.col(PID).alias("_o_pid"), *[F.col(g).alias(f"_o_group_{i}") for i, g in enumerate(groups)],
                             *[f"_o_{v}" for v in values], *(["_after"] if next_of else []))
    on = F.col(PID) == F.col("_o_pid")
    for i, g in enumerate(groups):
        on = on & ranged[g].eqNullSafe(F.col(f"_o_group_{i}"))
    out = ranged.join(offsets, on, "inner").drop("_o_pid", *[f"_o_group_{i}" for i in range(len(groups))])
    for v in values:
        out = out.withColumn(f"{prefix}{v}", F.sum(v).over(running) + F.col(f"_o_{v}"))
    if next_of:
        row = F.coalesce(F.lead(F.struct(*next_of)).over(Window.partitionBy(PID, *groups).orderBy(*order_cols)), F.col("_after"))
        out = out.withColumn("_next", row).select(*out.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in next_of]).drop("_after")
    return out.drop(PID, *[f"_o_{v}" for v in values])


def global_rank(df: DataFrame, order: list, groups: list[str] | None = None,
                out: str = "rank", partitions: int | None = None) -> DataFrame:
    """0-based row number in ``order`` (a total order) within ``groups``."""
    one = "_one"
    r = prefix_sums(df.withColumn(one, F.lit(1).cast("long")), order, [one], groups,
                    partitions=partitions)
    return r.withColumn(out, F.col(f"cum_{one}") - 1).drop(one, f"cum_{one}")
