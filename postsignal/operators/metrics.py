"""Evaluation suite (AGG-1, AGG-7 ... AGG-25, WIN-1 ... WIN-4, EVL-1).

Rules for undefined values: a ratio whose denominator is 0 is 0 for the
threshold metrics (as the reference's ``zero_division``); ranking metrics,
curve ordinates, lift, coefficients of variation and improvement percentages
are NULL (one class only, no positives, a mean or loss of 0).  Rows without a
score or a label take no part in any metric.

Threshold metrics are conditional sums in one aggregate (C3).  Ranking metrics
(ROC AUC with ties, PR AUC anchored at (0, 1), average precision, curves) are
exact and come from one table of distinct scores with running counts, built
by ``prefix.prefix_sums`` (C2) -- never a single-task global window.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import freeze, global_rank, prefix_sums

# ---------------------------------------------------------------------------
# Fixed values used by the reference's evaluation.
LOG_LOSS_EPS = 2.220446049250313e-16      # float64 machine epsilon
SWEEP_START, SWEEP_STEP, SWEEP_COUNT = 0.1, 0.01, 80   # 0.10 ... 0.89
# the grid is start + i * delta with delta = (start + step) - start, as an
# evenly spaced float range is filled; delta is 0.009999999999999995, not 0.01
SWEEP_DELTA = (SWEEP_START + SWEEP_STEP) - SWEEP_START
IMBALANCE_BAND = (0.5, 2.0)               # class_weight skipped inside this band
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(default))


# -- threshold metrics (AGG-7, AGG-8, AGG-9) -------------------------------
def confusion_sums(label="label", decision="decision") -> list[Column]:
    y, d = _c(label), _c(decision)
    return [F.sum(((y == 1) & (d == 1)).cast("long")).alias("tp"),
            F.sum(((y == 0) & (d == 1)).cast("long")).alias("fp"),
            F.sum(((y == 1) & (d == 0)).cast("long")).alias("fn"),
            F.sum(((y == 0) & (d == 0)).cast("long")).alias("tn")]


def _rates(tp, fp, fn, tn) -> list[Column]:
    tp, fp, fn, tn = (_c(x) for x in (tp, fp, fn, tn))
    return [_safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            _safe_div(tp, tp + fp).alias("precision"),
            _safe_div(tp, tp + fn).alias("recall"),
            _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion_matrix(df: DataFrame, label="label", decision="decision") -> DataFrame:
    """All four cells, zeros included, from one aggregate."""
    s = df.agg(*confusion_sums(label, decision))
    return s.selectExpr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, n)")


def binary_metrics(df: DataFrame, label="label", decision="decision", groups: list[str] | None = None) -> DataFrame:
    g = list(groups or [])
    s = (df.groupBy(*g) if g else df).agg(*confusion_sums(label, decision))
    return s.select(*g, *_rates("tp", "fp", "fn", "tn"))


def classification_report(df: DataFrame, label="label", decision="decision") -> DataFrame:
    s = df.agg(*confusion_sums(label, decision))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def cls(name, tp_, fp_, fn_):
        return F.struct(F.lit(name).alias("class"), _safe_div(tp_, tp_ + fp_).alias("precision"),
                        _safe_div(tp_, tp_ + fn_).alias("recall"),
                        _safe_div(2 * tp_, 2 * tp_ + fp_ + fn_).alias("f1"), (tp_ + fn_).alias("support"))

    c0, c1 = cls("0", tn, fn, fp), cls("1", tp, fp, fn)
    rows = s.select(c0.alias("c0"), c1.alias("c1"), n.alias("n"), _safe_div(tp + tn, n).alias("acc"))

    def avg(name, w0: Column, w1: Column, den: Column):
        return F.struct(F.lit(name).alias("class"),
                        *[((F.col(f"c0.{m}") * w0 + F.col(f"c1.{m}") * w1) / den).alias(m)
                          for m in ("precision", "recall", "f1")],
                        F.col("n").alias("support"))

    macro = avg("macro avg", F.lit(1.0), F.lit(1.0), F.lit(2.0))
    weighted = avg("weighted avg", F.col("c0.support"), F.col("c1.support"), F.col("n"))
    accuracy = F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                        F.col("n").alias("support"))
    return rows.select(F.explode(F.array(F.col("c0"), F.col("c1"), macro, weighted, accuracy)).alias("r")) \
        .select("r.*")


# -- probability metrics (AGG-13 ... AGG-16) -----------------------------------
def brier_expr(label="label", p="score") -> Column:
    return F.avg(F.pow(_c(p) - _c(label), 2))


def log_loss_expr(label="label", p="score", eps: float = LOG_LOSS_EPS) -> Column:
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))
    y = _c(label)
    return F.avg(-(y * F.log(q) + (F.lit(1) - y) * F.log(F.lit(1.0) - q)))


def calibration_gain(df: DataFrame, label="label", before="score", after="calibrated") -> DataFrame:
    """AGG-13 ... AGG-15: Brier and log loss before/after and the improvement in percent."""
    s = df.agg(brier_expr(label, before).alias("brier_before"), brier_expr(label, after).alias("brier_after"),
               log_loss_expr(label, before).alias("log_loss_before"),
               log_loss_expr(label, after).alias("log_loss_after"))
    return s.select("*",
                    (F.try_divide(F.col("brier_before") - F.col("brier_after"), F.col("brier_before")) * 100)
                    .alias("brier_improvement_pct"),
                    (F.try_divide(F.col("log_loss_before") - F.col("log_loss_after"), F.col("log_loss_before")) * 100)
                    .alias("log_loss_improvement_pct"))


def uniform_bin(p, bins: int = 10) -> Column:
    """Bin of ``p`` among ``bins`` uniform bins on [0, 1]; a value on an inner
    edge goes to the lower bin (edges are ``k * (1 / bins)``)."""
    step = 1.0 / bins
    terms = [(_c(p) > F.lit(k * step)).cast("int") for k in range(1, bins)]
    out = F.lit(0)
    for t in terms:
        out = out + t
    return out


def calibration_curve(df: DataFrame, label="label", p="score", bins: int = 10) -> DataFrame:
    """AGG-16: mean predicted p and positive share per non-empty bin."""
    return (df.select(uniform_bin(p, bins).alias("bin"), _c(label).alias("y"), _c(p).alias("p"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("prob_pred"),
                                F.avg("y").alias("prob_true")))


# -- ranking metrics (AGG-10 ... AGG-12, WIN-1, WIN-2) ------------------------------
def score_table(df: DataFrame, label="label", p="score", groups: list[str] | None = None, following: bool = False) -> DataFrame:
    """Distinct scores (per group), descending, with running counts.

    Columns: groups, score, pos, neg, tp (= positives with score >= this),
    fp, P, N, idx (0-based position in descending order); ``following`` adds
    next_pos and next_neg, the counts of the next lower score (null after the last).
    """
    g = list(groups or [])
    if len(g) > 1:
        raise ValueError("ranking metrics take at most one group column")
    labelled = df.select(*g, _c(p).alias("score"), _c(label).alias("y")).where("score IS NOT NULL AND y IS NOT NULL")
    st = (labelled.groupBy(*g, "score")
          .agg(F.sum("y").cast("long").alias("pos"),
               (F.count(F.lit(1)) - F.sum("y")).cast("long").alias("neg"))
          .withColumn("cnt", F.lit(1).cast("long")))
    pre = prefix_sums(st, [F.col("score").desc()], ["pos", "neg", "cnt"], g, next_of=["pos", "neg"] if following else None,
                      first_of=lambda row: F.max_by(row, "score"))
    # totals from the input (a partial aggregate on a handful of groups), not from
    # the distinct-score table, whose aggregation is the expensive shuffle
    totals = (labelled.groupBy(*[F.col(c).alias("_group") for c in g]) if g else labelled).agg(
        F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("P"),
        (F.count(F.lit(1)) - F.coalesce(F.sum("y"), F.lit(0))).cast("long").alias("N"))
    out = (pre.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")
           .withColumn("idx", F.col("cum_cnt") - 1).drop("cnt", "cum_cnt"))
    if g:
        out = out.join(totals, out[g[0]].eqNullSafe(totals["_group"])).drop("_group")
    else:
        one = totals.first()
        out = out.withColumns({"P": F.lit(one["P"]), "N": F.lit(one["N"])})
    return out


def _ranking_terms() -> list[Column]:
    tp, fp, pos, neg = (F.col(x).cast("double") for x in ("tp", "fp", "pos", "neg"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    tp0, fp0 = tp - pos, fp - neg
    prec = tp / (tp + fp)
    prec0 = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    return [
        (neg * (2 * tp - pos)).alias("_auc"),
        (F.try_divide(tp - tp0, P) * (prec + prec0) / 2).alias("_prauc"),
        (F.try_divide(pos, P) * prec).alias("_ap"),
    ]


def ranking_metrics(df: DataFrame, label="label", p="score", groups: list[str] | None = None) -> DataFrame:
    """ROC AUC (ties count half), PR AUC (trapezoid from (0, 1)), average precision."""
    g = list(groups or [])
    st = score_table(df, label, p, g).select(*g, "P", "N", *_ranking_terms())
    # summed as decimals: the sum does not depend on the order in which parts meet
    total = lambda c: F.sum(F.col(c).cast("decimal(38,24)")).cast("double")
    agg = st.groupBy(*g, "P", "N").agg(F.sum("_auc").alias("_auc"), total("_prauc").alias("pr_auc"), total("_ap").alias("average_precision"))
    return agg.select(*g, F.try_divide(F.col("_auc"), F.lit(2.0) * F.col("P") * F.col("N")).alias("roc_auc"),
                      "pr_auc", "average_precision")


def roc_curve(df: DataFrame, label="label", p="score") -> DataFrame:
    """WIN-1: (threshold, fpr, tpr), corners only (collinear points dropped),
    starting at (inf, 0, 0)."""
    st = score_table(df, label, p, following=True)
    keep = ((F.col("idx") == 0) | F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    point = F.struct(F.col("score").cast("double").alias("threshold"),
                     F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double")).alias("fpr"),
                     F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("tpr"))
    start = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    # the first score brings the start along: one pass over the table
    return st.where(keep).select(F.explode(F.when(F.col("idx") == 0, F.array(start, point)).otherwise(F.array(point))).alias("r")).select("r.*")


def pr_curve(df: DataFrame, label="label", p="score") -> DataFrame:
    """WIN-2: (threshold, precision, recall) for every distinct score plus the
    final (precision 1, recall 0) point with a null threshold."""
    st = score_table(df, label, p)
    point = F.struct(F.col("score").cast("double").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                     _safe_div(F.col("tp"), F.col("P"), 1.0).alias("recall"))
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return st.select(F.explode(F.when(F.col("idx") == 0, F.array(point, end)).otherwise(F.array(point))).alias("r")).select("r.*")


# -- lift (AGG-17, WIN-3, WIN-4) ------------------------------------------------------
def lift_table(df: DataFrame, label="label", p="score", key="event_id", bins: int = 10,
               bin_by: str = "score") -> DataFrame:
    """Equal-frequency bins by score rank (descending, ties by key).

    bin = max(ceil(r * bins / (n - 1)) - 1, 0) for 0-based rank r, the
    quantile cut of the ranks.  Columns: bin, n, actual, predicted_proba,
    lift, cumulative_lift.
    """
    narrow = (df.select(_c(key).alias("_key"), _c(label).alias("y"), _c(p).alias("p"))
              .where("y IS NOT NULL AND p IS NOT NULL"))

    def bin_of(rank: Column, n) -> Column:
        denom = F.greatest(n - F.lit(1), F.lit(1))
        return F.greatest(F.floor((rank * bins + (denom - 1)) / denom).cast("long") - 1, F.lit(0))

    def sums(rows: DataFrame, count: Column, pos: Column, total: Column) -> DataFrame:
        return rows.groupBy("bin").agg(F.sum(count).alias("n"), F.sum(pos).alias("_pos"), F.sum(total).alias("_p"))

    if bin_by == "key":
        # the reference's literal behaviour: quantiles of the row label, not of the score
        ranked = global_rank(narrow, [F.col("_key").asc()]).withColumn("bin", bin_of(F.col("rank"), F.lit(narrow.count())))
        parts = sums(ranked, F.lit(1), F.col("y"), F.col("p"))
    else:
        # a score whose rows all fall into one bin needs only its counts; rows of the
        # at most ``bins - 1`` scores that lie across a bin edge are ranked by key
        n = F.col("P") + F.col("N")
        st = score_table(df, label, p).select("score", "pos", (F.col("pos") + F.col("neg")).alias("cnt"), n.alias("_n"),
                                              (F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")).alias("_at"))
        st = st.withColumn("bin", bin_of(F.col("_at"), F.col("_n"))).withColumn("_last", bin_of(F.col("_at") + F.col("cnt") - 1, F.col("_n")))
        # a row per bin, and one per score across an edge (no two cross the same): at most 2 * bins - 1 rows
        short = st.groupBy("bin", "_last").agg(F.sum("cnt").alias("n"), F.sum("pos").alias("_pos"), F.sum(F.col("score") * F.col("cnt")).alias("_p"),
                                               F.min("score").alias("score"), F.min("_at").alias("_at"), F.min("_n").alias("_n")).collect()
        spark = df.sparkSession
        parts = spark.createDataFrame([(r["bin"], r["n"], r["_pos"], float(r["_p"])) for r in short if r["bin"] == r["_last"]], "bin long, n long, _pos long, _p double")
        cut = [(float(r["score"]), r["_at"], r["_n"]) for r in short if r["bin"] < r["_last"]]
        if cut:
            edges = F.broadcast(spark.createDataFrame(cut, "score double, _at long, _n long"))
            across = global_rank(narrow.join(edges, F.col("p") == F.col("score")), [F.col("_key").asc()], groups=["score"])
            parts = parts.unionByName(sums(across.withColumn("bin", bin_of(F.col("rank") + F.col("_at"), F.col("_n"))), F.lit(1), F.col("y"), F.col("p")))
    per = (parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("_pos").cast("long").alias("_pos"), F.sum("_p").alias("_p"))
           .select("bin", "n", "_pos", (F.col("_pos") / F.col("n")).alias("actual"), (F.col("_p") / F.col("n")).alias("predicted_proba")))
    # windows below run over the <= bins rows of ``per`` only
    everything = Window.partitionBy()
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total_pos = F.sum("_pos").over(everything).cast("double")
    baseline = total_pos / F.sum("n").over(everything)
    return per.select("bin", "n", "actual", "predicted_proba",
                      F.try_divide(F.col("actual"), baseline).alias("lift"),
                      F.try_divide(F.sum("_pos").over(upto).cast("double"), total_pos * ((F.col("bin") + 1) / F.lit(float(bins))))
                      .alias("cumulative_lift"))


# -- threshold sweep (AGG-22, TOP-2) ----------------------------------------------------
def sweep_threshold(i) -> Column:
    return F.lit(SWEEP_START) + _c(i).cast("double") * F.lit(SWEEP_DELTA)


def sweep_cell(p) -> Column:
    """Number of grid thresholds strictly below ``p`` (0 ... 80), exact."""
    approx = F.floor((_c(p) - F.lit(SWEEP_START)) / F.lit(SWEEP_STEP)).cast("int") + 1
    c0 = F.least(F.greatest(approx, F.lit(0)), F.lit(SWEEP_COUNT))
    down = F.when((c0 > 0) & ~(_c(p) > sweep_threshold(c0 - 1)), c0 - 1).otherwise(c0)
    return F.when((down < SWEEP_COUNT) & (_c(p) > sweep_threshold(down)), down + 1).otherwise(down)


def threshold_sweep(df: DataFrame, label="label", p="score") -> DataFrame:
    """Precision, recall and F1 at 0.10 ... 0.89 (strict ``>``) from one
    81-cell histogram instead of 80 scans."""
    hist = (df.select(sweep_cell(p).alias("cell"), _c(label).alias("y")).groupBy("cell")
            .agg(F.sum("y").cast("long").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).cast("long").alias("neg")))
    grid = hist.select("*", F.explode(F.sequence(F.lit(0), F.lit(SWEEP_COUNT - 1))).alias("i"))
    agg = grid.groupBy("i").agg(
        F.sum(F.when(F.col("cell") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("cell") > F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("P"))
    tp, fp, P = F.col("tp"), F.col("fp"), F.col("P")
    fn = P - tp
    return agg.select(F.col("i").cast("int").alias("i"), sweep_threshold("i").alias("threshold"),
                      _safe_div(tp, tp + fp).alias("precision"), _safe_div(tp, P).alias("recall"),
                      _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """First grid point with the highest metric."""
    return sweep.orderBy(F.col(metric).desc(), F.col("i").asc()).limit(1)


# -- folds (AGG-18, AGG-19) ------------------------------------------------------------
def fold_metrics(df: DataFrame, label="label", p="score", fold="fold", threshold: float = 0.5) -> DataFrame:
    dec = (_c(p) > F.lit(threshold)).cast("int")
    thr = binary_metrics(df.withColumn("_d", dec), label, "_d", [fold]).drop("accuracy")
    rank = ranking_metrics(df, label, p, [fold]).drop("average_precision")
    return thr.join(rank, fold, "inner")


def fold_stability(fm: DataFrame, metrics=("f1", "precision", "recall")) -> DataFrame:
    """Mean, population std and coefficient of variation over folds."""
    long = fm.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                                          for m in metrics])).alias("r")).select("r.*")
    return (long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
            .withColumn("cv", F.try_divide(F.col("std"), F.col("mean"))))


def best_fold(fm: DataFrame, metric: str = "pr_auc", fold: str = "fold") -> DataFrame:
    return fm.orderBy(F.col(metric).desc(), F.col(fold).asc()).limit(1)


# -- class statistics (AGG-1, AGG-2, AGG-23 ... AGG-25) -----------------------------------
def class_distribution(df: DataFrame, label="label") -> DataFrame:
    counts = df.groupBy(_c(label).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # over the per-class rows only (k rows)
    k = F.count(F.lit(1)).over(w)
    n = F.sum("count").over(w)
    prop = F.col("count") / n
    with_p = counts.select("class", "count", prop.alias("proportion"), k.alias("n_classes"),
                           (F.max("count").over(w) / F.min("count").over(w)).alias("_ratio"))
    ent = -F.sum(F.when(F.col("proportion") > 0, F.col("proportion") * F.log2("proportion"))).over(w)
    ideal = F.when(F.col("n_classes") > 0, F.log2(F.col("n_classes").cast("double"))).otherwise(0.0)
    out = with_p.select("class", "count", "proportion", "n_classes",
                        F.when(F.col("n_classes") <= 1, F.lit(float("inf"))).otherwise(F.col("_ratio"))
                        .alias("imbalance_ratio"),
                        F.when(F.col("n_classes") <= 1, F.lit(0.0)).otherwise(ent).alias("entropy"),
                        ideal.alias("ideal_entropy"))
    return out.withColumn("uniformity", _safe_div(F.col("entropy"), F.col("ideal_entropy")))


def target_profile(df: DataFrame, target: str, threshold: float = 50.0) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg((_c(target) >= threshold).cast("double")).alias("positive_ratio"))


def class_weights(df: DataFrame, label="label", band=IMBALANCE_BAND) -> DataFrame:
    """n / (k * n_c) per class; all 1.0 when count0/count1 is inside ``band``
    or only one class exists.  ``scale_pos_weight`` = w1 / w0."""
    counts = df.groupBy(_c(label).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # k rows
    n, k = F.sum("count").over(w), F.count(F.lit(1)).over(w)
    c0 = F.max(F.when(F.col("class") == 0, F.col("count"))).over(w)
    c1 = F.max(F.when(F.col("class") == 1, F.col("count"))).over(w)
    ratio = F.try_divide(c0, c1)
    skip = (k <= 1) | ratio.between(band[0], band[1])
    weighted = counts.select("class", "count", F.when(skip, F.lit(1.0)).otherwise(n / (k * F.col("count")))
                             .alias("weight"))
    w0 = F.max(F.when(F.col("class") == 0, F.col("weight"))).over(w)
    w1 = F.max(F.when(F.col("class") == 1, F.col("weight"))).over(w)
    return weighted.withColumn("scale_pos_weight", F.try_divide(w1, w0))


def baselines(df: DataFrame, label="label") -> DataFrame:
    p = F.avg(_c(label).cast("double"))
    return df.agg(p.alias("positive_rate")).select(
        (2 * F.col("positive_rate") / (1 + F.col("positive_rate"))).alias("f1_always_positive"),
        F.col("positive_rate").alias("pr_baseline"))


def evaluate(df: DataFrame, label="label", raw="score", calibrated: str | None = None,
             threshold: float = 0.5) -> DataFrame:
    """EVL-1: decisions from the calibrated probability when given, ranking
    metrics from the raw one (one row)."""
    decide_on = calibrated or raw
    # C3: confusion counts and the threshold metrics come from one aggregate
    df = df.where(_c(raw).isNotNull() & _c(decide_on).isNotNull() & _c(label).isNotNull())
    conf = df.agg(*confusion_sums(label, (_c(decide_on) > F.lit(threshold)).cast("int")))
    thr = conf.select(*_rates("tp", "fp", "fn", "tn"), "tp", "fp", "fn", "tn")
    rank = ranking_metrics(df, label, raw).select("roc_auc", "pr_auc")
    # two one-row tables joined on a constant: no data shuffle
    a = thr.withColumn("_j", F.lit(1))
    b = rank.withColumn("_j", F.lit(1))
    return F.broadcast(a).join(F.broadcast(b), "_j").drop("_j").select(
        "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "tp", "fp", "fn", "tn")
