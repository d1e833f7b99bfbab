"""Driver-checked queries for the evaluation suite (AGG, WIN-1...4, TOP-2, EVL-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.structure import apply_threshold
from ..operators import metrics as M
from ..registry import register
from ..sources import fixtures as FX

R9 = 9


def _r(cols, df, digits=R9):
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _scored_with_decision(spark, sf_dir, t=0.5):
    return FX.scored(spark, sf_dir).withColumn("decision", apply_threshold("score", t))


def _calibrated(spark, sf_dir):
    """Scored rows plus a bin-rate calibrated probability (positive share of
    the row's uniform score bin), used as the 'after' column."""
    s = FX.scored(spark, sf_dir).withColumn("bin", M.uniform_bin("score", 10))
    rates = M.calibration_curve(s, "label", "score", 10).select("bin", F.col("prob_true").alias("calibrated"))
    # at most ``bins`` rows: a bounded broadcast
    return s.join(F.broadcast(rates), "bin", "left")


CAL_SQL = """
SELECT *, avg(label) OVER (PARTITION BY bin) AS calibrated
FROM (SELECT *, ({bin}) AS bin FROM scored) b"""

BIN_SQL = " + ".join(f"cast(score > {k} * (cast(1 AS double) / 10) AS int)" for k in range(1, 10))


# -- confusion / threshold metrics ---------------------------------------------
@register("confusion_matrix", """
SELECT a.actual, a.predicted, count(s.event_id) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) a(actual, predicted)
LEFT JOIN (SELECT event_id, label, cast(score > 0.5 AS int) AS d FROM scored) s
  ON s.label = a.actual AND s.d = a.predicted
GROUP BY a.actual, a.predicted""", ids=("AGG-7",))
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_scored_with_decision(spark, sf_dir))


METRIC_SQL = """
SELECT {keys}
  CASE WHEN count(*) > 0 THEN sum(cast(label = d AS int)) / count(*) ELSE 0 END AS accuracy,
  CASE WHEN sum(d) > 0 THEN sum(label * d) / sum(d) ELSE 0 END AS precision,
  CASE WHEN sum(label) > 0 THEN sum(label * d) / sum(label) ELSE 0 END AS recall,
  CASE WHEN sum(label) + sum(d) > 0 THEN 2 * sum(label * d) / (sum(label) + sum(d)) ELSE 0 END AS f1
FROM (SELECT *, cast(score > 0.5 AS int) AS d FROM {src}) s {group}"""


@register("binary_metrics", METRIC_SQL.format(keys="", src="scored", group=""), ids=("AGG-8",))
def binary_metrics(spark, sf_dir):
    return M.binary_metrics(_scored_with_decision(spark, sf_dir))


@register("classification_report", """
WITH s AS (SELECT label, cast(score > 0.5 AS int) AS d FROM scored),
c AS (SELECT cls, sum(cast(label = cls AND d = cls AS int)) AS tp, sum(cast(label <> cls AND d = cls AS int)) AS fp,
             sum(cast(label = cls AND d <> cls AS int)) AS fn, sum(cast(label = cls AS int)) AS support
      FROM s, (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT cast(cls AS varchar) AS class,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
             cast(support AS bigint) AS support FROM c)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM m
UNION ALL
SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::bigint FROM m
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
       round(sum(f1 * support) / sum(support), 9), sum(support)::bigint FROM m
UNION ALL
SELECT 'accuracy', NULL, NULL, round(avg(cast(label = d AS int)), 9), count(*) FROM s""", ids=("AGG-9",))
def classification_report(spark, sf_dir):
    rep = M.classification_report(_scored_with_decision(spark, sf_dir))
    return _r({"precision", "recall", "f1"}, rep)


# -- ranking metrics -------------------------------------------------------------
RANK_SQL = """
WITH r AS (SELECT label, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS ties FROM scored),
t AS (SELECT sum(label) AS P, count(*) - sum(label) AS N FROM scored)
SELECT round((sum(CASE WHEN label = 1 THEN lo + (ties - 1) / 2.0 END) - P * (P + 1) / 2.0)
             / (cast(P AS double) * N), 9) AS roc_auc
FROM r, t GROUP BY P, N"""


@register("roc_auc", RANK_SQL, ids=("AGG-10",))
def roc_auc(spark, sf_dir):
    return _r({"roc_auc"}, M.ranking_metrics(FX.scored(spark, sf_dir)).select("roc_auc"))


PR_POINTS_SQL = """
WITH g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT sum(pos) AS P FROM g),
pts AS (SELECT score, cast(tp AS double) / P AS recall, cast(tp AS double) / (tp + fp) AS precision FROM c, t),
seq AS (SELECT recall, precision, lag(recall, 1, 0.0) OVER (ORDER BY score DESC) AS r0,
               lag(precision, 1, 1.0) OVER (ORDER BY score DESC) AS p0 FROM pts)"""


@register("pr_auc", PR_POINTS_SQL + """
SELECT round(sum((recall - r0) * (precision + p0) / 2), 9) AS pr_auc FROM seq""", ids=("AGG-11",))
def pr_auc(spark, sf_dir):
    return _r({"pr_auc"}, M.ranking_metrics(FX.scored(spark, sf_dir)).select("pr_auc"))


@register("average_precision", PR_POINTS_SQL + """
SELECT round(sum((recall - r0) * precision), 9) AS average_precision FROM seq""", ids=("AGG-12",))
def average_precision(spark, sf_dir):
    return _r({"average_precision"}, M.ranking_metrics(FX.scored(spark, sf_dir)).select("average_precision"))


@register("roc_curve", """
WITH g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             lead(pos) OVER w2 AS npos, lead(neg) OVER w2 AS nneg, row_number() OVER w2 - 1 AS idx,
             count(*) OVER () AS m
      FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    w2 AS (ORDER BY score DESC)),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
SELECT cast('inf' AS double) AS threshold, cast(0 AS double) AS fpr, cast(0 AS double) AS tpr
UNION ALL
SELECT score, fp / N, tp / P FROM c, t
WHERE idx = 0 OR idx = m - 1 OR m <= 2 OR npos <> pos OR nneg <> neg""", ids=("WIN-1",))
def roc_curve(spark, sf_dir):
    return M.roc_curve(FX.scored(spark, sf_dir))


@register("pr_curve", """
WITH g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT sum(pos) AS P FROM g)
SELECT score AS threshold, tp / (tp + fp) AS precision, tp / P AS recall FROM c, t
UNION ALL SELECT NULL, cast(1 AS double), cast(0 AS double)""", ids=("WIN-2",))
def pr_curve(spark, sf_dir):
    return M.pr_curve(FX.scored(spark, sf_dir))


# -- probability metrics ------------------------------------------------------------
@register("brier_score", "SELECT round(avg(power(score - label, 2)), 9) AS brier_before, "
          "round(avg(power(calibrated - label, 2)), 9) AS brier_after FROM ({cal}) x".format(
              cal=CAL_SQL.format(bin=BIN_SQL)), ids=("AGG-13",))
def brier_score(spark, sf_dir):
    g = M.calibration_gain(_calibrated(spark, sf_dir))
    return _r({"brier_before", "brier_after"}, g.select("brier_before", "brier_after"))


LL = ("-(label * ln(least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) + "
      "(1 - label) * ln(1 - least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))")


@register("log_loss", "SELECT round(avg({b}), 9) AS log_loss_before, round(avg({a}), 9) AS log_loss_after "
          "FROM ({cal}) x".format(b=LL.format(p="score"), a=LL.format(p="calibrated"),
                                  cal=CAL_SQL.format(bin=BIN_SQL)), ids=("AGG-14",))
def log_loss(spark, sf_dir):
    g = M.calibration_gain(_calibrated(spark, sf_dir))
    return _r({"log_loss_before", "log_loss_after"}, g.select("log_loss_before", "log_loss_after"))


@register("calibration_gain", """
SELECT round((bb - ba) / bb * 100, 6) AS brier_improvement_pct, round((lb - la) / lb * 100, 6) AS log_loss_improvement_pct
FROM (SELECT avg(power(score - label, 2)) AS bb, avg(power(calibrated - label, 2)) AS ba,
             avg({b}) AS lb, avg({a}) AS la FROM ({cal}) x) s""".format(
    b=LL.format(p="score"), a=LL.format(p="calibrated"), cal=CAL_SQL.format(bin=BIN_SQL)), ids=("AGG-15",))
def calibration_gain(spark, sf_dir):
    g = M.calibration_gain(_calibrated(spark, sf_dir))
    return _r({"brier_improvement_pct", "log_loss_improvement_pct"},
              g.select("brier_improvement_pct", "log_loss_improvement_pct"), 6)


@register("calibration_curve", f"""
SELECT bin, count(*) AS n, round(avg(score), 9) AS prob_pred, round(avg(label), 9) AS prob_true
FROM (SELECT *, ({BIN_SQL}) AS bin FROM scored) b GROUP BY bin""", ids=("AGG-16",))
def calibration_curve(spark, sf_dir):
    return _r({"prob_pred", "prob_true"}, M.calibration_curve(FX.scored(spark, sf_dir)))


# -- lift ------------------------------------------------------------------------------
@register("lift_table", """
WITH r AS (SELECT label, score, row_number() OVER (ORDER BY score DESC, event_id) - 1 AS rk,
                  count(*) OVER () AS n FROM scored),
b AS (SELECT label, score, greatest(cast(ceil(rk * 10 / cast(n - 1 AS double)) AS bigint) - 1, 0) AS bin FROM r),
per AS (SELECT bin, count(*) AS n, sum(label) AS pos, avg(label) AS actual, avg(score) AS predicted_proba
        FROM b GROUP BY bin),
tot AS (SELECT sum(pos) AS tp, sum(n) AS total FROM per)
SELECT bin, n, round(actual, 9) AS actual, round(predicted_proba, 9) AS predicted_proba,
       round(actual / (tp / cast(total AS double)), 9) AS lift,
       round(sum(pos) OVER (ORDER BY bin) / (tp * ((bin + 1) / cast(10 AS double))), 9) AS cumulative_lift
FROM per, tot""", ids=("AGG-17", "WIN-3", "WIN-4"))
def lift_table(spark, sf_dir):
    lt = M.lift_table(FX.scored(spark, sf_dir), "label", "score", "event_id", 10)
    return _r({"actual", "predicted_proba", "lift", "cumulative_lift"}, lt)


@register("cumulative_lift", """
WITH r AS (SELECT label, row_number() OVER (ORDER BY score DESC, event_id) - 1 AS rk, count(*) OVER () AS n
           FROM scored),
b AS (SELECT label, greatest(cast(ceil(rk * 10 / cast(n - 1 AS double)) AS bigint) - 1, 0) AS bin FROM r)
SELECT bin, round(sum(sum(label)) OVER (ORDER BY bin) / (sum(sum(label)) OVER () * ((bin + 1) / cast(10 AS double))), 9)
       AS cumulative_lift
FROM b GROUP BY bin""", ids=("WIN-4",))
def cumulative_lift(spark, sf_dir):
    lt = M.lift_table(FX.scored(spark, sf_dir), "label", "score", "event_id", 10)
    return _r({"cumulative_lift"}, lt.select("bin", "cumulative_lift"))


# -- threshold sweep ----------------------------------------------------------------------
SWEEP_SQL = """
WITH g AS (SELECT i, cast(0.1 AS double) + i * ((cast(0.1 AS double) + cast(0.01 AS double)) - cast(0.1 AS double))
                   AS threshold FROM range(80) t(i)),
c AS (SELECT i, threshold, sum(cast(score > threshold AND label = 1 AS int)) AS tp,
             sum(cast(score > threshold AND label = 0 AS int)) AS fp, sum(label) AS P
      FROM g CROSS JOIN scored GROUP BY i, threshold),
m AS (SELECT cast(i AS int) AS i, threshold,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN P > 0 THEN tp / P ELSE 0 END AS recall,
             CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0 END AS f1 FROM c)"""


@register("threshold_sweep", SWEEP_SQL + "\nSELECT * FROM m", ids=("AGG-22",))
def threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(FX.scored(spark, sf_dir))


@register("best_threshold", SWEEP_SQL + "\nSELECT * FROM m ORDER BY f1 DESC, i LIMIT 1", ids=("AGG-22", "TOP-2"))
def best_threshold(spark, sf_dir):
    return M.best_threshold(M.threshold_sweep(FX.scored(spark, sf_dir)))


# -- folds -------------------------------------------------------------------------------
FOLD_SQL = """
WITH g AS (SELECT fold, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM folds GROUP BY fold, score),
c AS (SELECT fold, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g
      WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT fold, sum(pos) AS P, sum(neg) AS N FROM g GROUP BY fold),
pts AS (SELECT c.fold, score, pos, neg, P, N, cast(tp AS double) / P AS recall, cast(tp AS double) / (tp + fp) AS precision
        FROM c JOIN t ON t.fold = c.fold),
seq AS (SELECT *, lag(recall, 1, 0.0) OVER w AS r0, lag(precision, 1, 1.0) OVER w AS p0,
               coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS neg_below
        FROM pts WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
rk AS (SELECT fold, round(sum(pos * (neg_below + neg / 2.0)) / (cast(P AS double) * N), 9) AS roc_auc,
              round(sum((recall - r0) * (precision + p0) / 2), 9) AS pr_auc FROM seq GROUP BY fold, P, N),
thr AS (SELECT fold,
  CASE WHEN sum(d) > 0 THEN sum(label * d) / sum(d) ELSE 0 END AS precision,
  CASE WHEN sum(label) > 0 THEN sum(label * d) / sum(label) ELSE 0 END AS recall,
  CASE WHEN sum(label) + sum(d) > 0 THEN 2 * sum(label * d) / (sum(label) + sum(d)) ELSE 0 END AS f1
  FROM (SELECT *, cast(score > 0.5 AS int) AS d FROM folds) s GROUP BY fold),
fm AS (SELECT thr.fold, precision, recall, f1, roc_auc, pr_auc FROM thr JOIN rk ON rk.fold = thr.fold)"""


def _fold_metrics(spark, sf_dir):
    fm = M.fold_metrics(FX.folds(spark, sf_dir))
    return _r({"roc_auc", "pr_auc"}, fm)


@register("fold_metrics", FOLD_SQL + "\nSELECT * FROM fm", ids=("AGG-19",))
def fold_metrics(spark, sf_dir):
    return _fold_metrics(spark, sf_dir)


@register("best_fold", FOLD_SQL + "\nSELECT * FROM fm ORDER BY pr_auc DESC, fold LIMIT 1", ids=("TOP-2", "ML-8"))
def best_fold(spark, sf_dir):
    return M.best_fold(_fold_metrics(spark, sf_dir), "pr_auc")


@register("fold_stability", FOLD_SQL + """,
l AS (SELECT 'f1' AS metric, f1 AS v FROM fm UNION ALL SELECT 'precision', precision FROM fm
      UNION ALL SELECT 'recall', recall FROM fm)
SELECT metric, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(stddev_pop(v) / avg(v), 9) AS cv
FROM l GROUP BY metric""", ids=("AGG-18",))
def fold_stability(spark, sf_dir):
    fm = M.fold_metrics(FX.folds(spark, sf_dir))
    return _r({"mean", "std", "cv"}, M.fold_stability(fm))


# -- class statistics ------------------------------------------------------------------------
@register("class_distribution", """
WITH c AS (SELECT toxic AS class, count(*) AS count FROM labels GROUP BY toxic),
s AS (SELECT *, count / sum(count) OVER () AS proportion, count(*) OVER () AS n_classes,
             max(count) OVER () / min(count) OVER () AS ratio FROM c),
e AS (SELECT *, -sum(proportion * log2(proportion)) OVER () AS ent FROM s)
SELECT class, count, round(proportion, 9) AS proportion, n_classes,
       CASE WHEN n_classes <= 1 THEN cast('inf' AS double) ELSE round(ratio, 9) END AS imbalance_ratio,
       CASE WHEN n_classes <= 1 THEN 0 ELSE round(ent, 9) END AS entropy,
       round(log2(n_classes), 9) AS ideal_entropy,
       CASE WHEN log2(n_classes) > 0 THEN round((CASE WHEN n_classes <= 1 THEN 0 ELSE ent END) / log2(n_classes), 9)
            ELSE 0 END AS uniformity
FROM e""", ids=("AGG-1",))
def class_distribution(spark, sf_dir):
    lab = FX.table(spark, sf_dir, "labels")
    d = M.class_distribution(lab, "toxic")
    return _r({"proportion", "imbalance_ratio", "entropy", "ideal_entropy", "uniformity"}, d)


@register("target_profile", """
SELECT count(*) AS n, round(avg(cast(total_trade_volume >= 50 AS double)), 9) AS positive_ratio FROM posts""",
          ids=("AGG-2",))
def target_profile(spark, sf_dir):
    return _r({"positive_ratio"}, M.target_profile(FX.posts(spark, sf_dir), "total_trade_volume", 50.0))


@register("class_weights", """
WITH c AS (SELECT toxic AS class, count(*) AS count FROM labels GROUP BY toxic),
s AS (SELECT *, sum(count) OVER () AS n, count(*) OVER () AS k,
             max(CASE WHEN class = 0 THEN count END) OVER () / max(CASE WHEN class = 1 THEN count END) OVER () AS ratio
      FROM c),
w AS (SELECT class, count, CASE WHEN k <= 1 OR ratio BETWEEN 0.5 AND 2.0 THEN cast(1 AS double)
                                ELSE n / (k * count) END AS weight FROM s)
SELECT class, count, round(weight, 9) AS weight,
       round(max(CASE WHEN class = 1 THEN weight END) OVER () / max(CASE WHEN class = 0 THEN weight END) OVER (), 9)
         AS scale_pos_weight
FROM w""", ids=("AGG-23", "AGG-24"))
def class_weights(spark, sf_dir):
    lab = FX.table(spark, sf_dir, "labels")
    return _r({"weight", "scale_pos_weight"}, M.class_weights(lab, "toxic"))


@register("baselines", """
SELECT round(2 * avg(label) / (1 + avg(label)), 9) AS f1_always_positive, round(avg(label), 9) AS pr_baseline
FROM scored""", ids=("AGG-25",))
def baselines(spark, sf_dir):
    return _r({"f1_always_positive", "pr_baseline"}, M.baselines(FX.scored(spark, sf_dir)))


@register("evaluate", f"""
WITH x AS ({CAL_SQL.format(bin=BIN_SQL)}),
d AS (SELECT label, cast(calibrated > 0.5 AS int) AS d FROM x),
thr AS (SELECT
  CASE WHEN count(*) > 0 THEN sum(cast(label = d AS int)) / count(*) ELSE 0 END AS accuracy,
  CASE WHEN sum(d) > 0 THEN sum(label * d) / sum(d) ELSE 0 END AS precision,
  CASE WHEN sum(label) > 0 THEN sum(label * d) / sum(label) ELSE 0 END AS recall,
  CASE WHEN sum(label) + sum(d) > 0 THEN 2 * sum(label * d) / (sum(label) + sum(d)) ELSE 0 END AS f1,
  sum(label * d)::bigint AS tp, sum((1 - label) * d)::bigint AS fp, sum(label * (1 - d))::bigint AS fn,
  sum((1 - label) * (1 - d))::bigint AS tn FROM d),
auc AS ({RANK_SQL.replace("scored", "x")}),
pr AS ({PR_POINTS_SQL} SELECT round(sum((recall - r0) * (precision + p0) / 2), 9) AS pr_auc FROM seq)
SELECT thr.*, auc.roc_auc, pr.pr_auc FROM thr, auc, pr""", ids=("EVL-1", "AGG-7", "AGG-8", "AGG-10", "AGG-11", "CAL-3"))
def evaluate(spark, sf_dir):
    ev = M.evaluate(_calibrated(spark, sf_dir), "label", "score", "calibrated", 0.5)
    return _r({"roc_auc", "pr_auc"}, ev)


# -- undefined values: one class, no positives -------------------------------------
@register("one_class_metrics", """
SELECT cls, cast(NULL AS double) AS roc_auc, CASE WHEN cls = 1 THEN cast(1 AS double) END AS pr_auc,
       sum(cast(score > 0.5 AND label = 1 AS int))::bigint AS tp, sum(cast(score > 0.5 AND label = 0 AS int))::bigint AS fp,
       sum(cast(score <= 0.5 AND label = 1 AS int))::bigint AS fn, sum(cast(score <= 0.5 AND label = 0 AS int))::bigint AS tn,
       CASE WHEN cls = 1 THEN cast(1 AS double) END AS first_lift
FROM (SELECT *, label AS cls FROM scored) s GROUP BY cls""", ids=("EVL-1", "AGG-10", "AGG-11", "AGG-17"))
def one_class_metrics(spark, sf_dir):
    """Each class of the scored rows alone: ranking metrics without a counterpart are null, lift without positives too."""
    out = None
    for cls in (0, 1):
        part = FX.scored(spark, sf_dir).where(F.col("label") == cls)
        e = M.evaluate(part).select(F.lit(cls).alias("cls"), "roc_auc", F.round("pr_auc", R9).alias("pr_auc"), "tp", "fp", "fn", "tn")
        lift = M.lift_table(part).where("bin = 0").select(F.lit(cls).alias("cls"), F.round("lift", R9).alias("first_lift"))
        row = e.join(lift, "cls")
        out = row if out is None else out.unionByName(row)
    return out


@register("zero_mean_stability", """
SELECT m AS metric, cast(0 AS double) AS mean, cast(0 AS double) AS std, cast(NULL AS double) AS cv
FROM (VALUES ('f1'), ('precision'), ('recall')) t(m)""", ids=("AGG-18",))
def zero_mean_stability(spark, sf_dir):
    """Folds in which no decision is ever positive: all three metrics are 0, so the coefficient of variation is null."""
    return M.fold_stability(M.fold_metrics(FX.folds(spark, sf_dir), threshold=2.0))
