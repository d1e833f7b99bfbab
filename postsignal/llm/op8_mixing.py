"""Mixing sources to target weights along a time-varying curriculum.

*Targets.*  Sources, in code point order (null last), take the weights in turn
and share ``share`` times all words; a target stops at ``most`` times its
source's words and the excess goes to the others by weight.  The water level
is found by a few aggregates over the per-source table.

*What is taken.*  A source's rows stand in a seeded hash order; the mix walks
through that order, again and again, until the target is met, so the taken
words of a source equal its rounded target, a row is taken at most
``ceil(most)`` times, and at most one row per source is taken in part.

*When.*  Every weight class has a schedule, a piecewise linear factor over
training progress 0..1.  Its integral, scaled to the source's target, is the
source's cumulative token demand; inverting it at a row's place in the walk
gives the row's training position.  ``training_order`` range-sorts by it.

The running sums are range-partitioned (``operators.prefix``), so one source
with most rows is spread over many tasks.  Hash and order use the row's content
only: reruns agree.

Defined cases: a null text has 0 words; rows of 0 words are not taken and have
no position; a null source is a source of its own; equal rows are separate
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import freeze, global_rank, prefix_sums

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    #: per weight class, (progress, factor) knots from 0 to 1 with factors >= 0, not all 0
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.4), (0.5, 1.0), (1.0, 0.6)),
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 0.4), (0.7, 1.0), (1.0, 1.9)),
    )
    seed: int = 17


def demand(schedule: tuple[tuple[float, float], ...], t: float) -> float:
    """The share of a schedule's tokens that is demanded up to progress ``t``."""
    def area(to):
        s = 0.0
        for (t0, y0), (t1, y1) in zip(schedule, schedule[1:]):
            x = min(max(to - t0, 0.0), t1 - t0)
            s += y0 * x + (y1 - y0) / (t1 - t0) * x * x / 2
        return s
    return area(t) / area(1.0)


def progress_at(schedule: tuple[tuple[float, float], ...], part: Column) -> Column:
    """Inverse of ``demand``: the progress at which ``part`` (0..1) of the tokens is used up."""
    total, whole = 0.0, sum((y0 + y1) / 2 * (t1 - t0) for (t0, y0), (t1, y1) in zip(schedule, schedule[1:]))
    out = None
    for (t0, y0), (t1, y1) in zip(schedule, schedule[1:]):
        rest = F.greatest(part * whole - total, F.lit(0.0))
        slope = (y1 - y0) / (t1 - t0)
        x = F.lit(2.0) * rest / (y0 + F.sqrt(F.greatest(F.lit(y0 * y0) + 2 * slope * rest, F.lit(0.0))))
        here = F.when(rest == 0, F.lit(float(t0))).otherwise(t0 + F.least(x, F.lit(t1 - t0)))
        total += (y0 + y1) / 2 * (t1 - t0)
        out = F.when(part * whole <= total, here) if out is None else out.when(part * whole <= total, here)
    return out.otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(key, source, source_size) plus ``class`` (weight class) and ``target``; one row per source."""
    p = params
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], out="_rank")
    kind = (F.col("_rank") % len(p.weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), kind + 1)
    ranked = freeze(ranked.withColumn("class", kind).withColumn("weight", weight).drop("_rank"))
    cap = F.col("source_size") * p.most
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = p.share * (total or 0)
    level, capped = (budget / weights if weights else 0.0), -1
    while True:
        full = cap <= F.col("weight") * level
        used, left, n = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == capped or not left:
            break
        level, capped = (budget - (used or 0.0)) / left, n
    target = F.least(cap, F.col("weight") * level) if left else cap
    return ranked.withColumn("target", target.cast("double")).drop("weight")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        params: MixParams = MixParams()) -> DataFrame:
    """One row per document row: ``id, source, size, source_size, target, taken, takes, position`` and ``h1, h2``.

    ``takes``: array of (take, words, position), one per time the row is taken;
    ``position``: of the first.  ``h1, h2``: content hashes that name the row
    (equal rows share them).
    """
    p = params
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(p.seed), F.col(id_col).cast("long"), source, text).alias("h1"),
        F.xxhash64(F.lit(p.seed + 1), source, text, F.col(id_col).cast("long")).alias("h2"))
    walk = freeze(prefix_sums(rows, ["h1", "h2"], ["size"], ["key"]))
    sizes = walk.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, p).drop("source")
    joined = walk.join(targets, "key")
    goal = F.round("target").cast("long")
    start = F.col("cum_size") - F.col("size")
    takes = []
    for k in range(math.ceil(p.most)):
        begin = start + F.col("source_size") * k
        part = (begin / F.greatest(goal, F.lit(1))).cast("double")
        position = None
        for c, schedule in enumerate(p.schedules):
            at = progress_at(schedule, part)
            position = F.when(F.col("class") == c, at) if position is None else position.when(F.col("class") == c, at)
        takes.append(F.struct(
            F.lit(k).alias("take"),
            F.greatest(F.least(goal - begin, F.col("size")), F.lit(0)).cast("long").alias("words"),
            position.alias("position")))
    return (joined.withColumn("takes", F.filter(F.array(*takes), lambda x: x["words"] > 0))
            .withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
            .withColumn("position", F.try_element_at("takes", F.lit(1))["position"])
            .select("id", "source", "size", "source_size", "target", "taken", "takes", "position", "h1", "h2"))


def training_order(mixed: DataFrame) -> DataFrame:
    """The mixed rows range-sorted by their first training position (untaken rows last)."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "h1", "h2")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    params: MixParams = MixParams()) -> DataFrame:
    """``docs``, one row per take in training order, columns unchanged.

    Texts stay whole: the row at a source's boundary is taken if at least half
    of its words are.
    """
    p = params
    takes = (mix(docs, id_col, text_col, source_col, p)
             .select("h1", "h2", "size", F.explode("takes").alias("t"))
             .filter(F.col("t.words") * 2 >= F.col("size"))
             .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("t.position").alias("_position"), F.col("t.take").alias("_take")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.col(source_col).cast("string")
    row = F.struct(*[F.col(c) for c in docs.columns])
    named = docs.select(
        row.alias("_row"),
        F.xxhash64(F.lit(p.seed), F.col(id_col).cast("long"), source, text).alias("_h1"),
        F.xxhash64(F.lit(p.seed + 1), source, text, F.col(id_col).cast("long")).alias("_h2"))
    one = Window.partitionBy("_h1", "_h2").orderBy(F.lit(0))
    unique = named.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    return (unique.join(takes, ["_h1", "_h2"]).orderBy("_position", "_h1", "_h2", "_take").select("_row.*"))
