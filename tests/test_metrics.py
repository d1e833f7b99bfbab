"""Evaluation suite against brute-force Python definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsignal.operators import metrics as M
from postsignal.operators.prefix import global_rank, prefix_sums


def _df(spark, ys, ps, keys=None):
    keys = keys or list(range(len(ys)))
    return spark.createDataFrame([(int(k), int(y), float(p)) for k, y, p in zip(keys, ys, ps)],
                                 "event_id long, label int, score double")


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def pr_points(ys, ps):
    """sklearn-style curve: thresholds = distinct scores, descending."""
    P = sum(ys)
    pts = []
    for t in sorted(set(ps), reverse=True):
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 0)
        pts.append((tp / P, tp / (tp + fp)))
    return pts


def brute_pr_auc(ys, ps):
    pts = [(0.0, 1.0)] + pr_points(ys, ps)
    return sum((r1 - r0) * (p1 + p0) / 2 for (r0, p0), (r1, p1) in zip(pts, pts[1:]))


def brute_ap(ys, ps):
    pts = [(0.0, 1.0)] + pr_points(ys, ps)
    return sum((r1 - r0) * p1 for (r0, _), (r1, p1) in zip(pts, pts[1:]))


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(3)
    ys = [rng.randint(0, 1) for _ in range(300)]
    ps = [round(rng.random(), 1) for _ in range(300)]       # heavy ties
    r = M.ranking_metrics(_df(spark, ys, ps)).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(ys, ps), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(brute_pr_auc(ys, ps), abs=1e-12)
    assert r["average_precision"] == pytest.approx(brute_ap(ys, ps), abs=1e-12)


def test_mixed_top_tie_pr_auc(spark):
    # top score shared by one positive and one negative: anchor at (0, 1)
    ys, ps = [1, 0, 1, 0], [0.9, 0.9, 0.5, 0.1]
    r = M.ranking_metrics(_df(spark, ys, ps)).first()
    assert r["pr_auc"] == pytest.approx(brute_pr_auc(ys, ps), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(0.6666666666666666, abs=1e-9)


def test_auc_invariant_to_monotone_transform(spark):
    rng = random.Random(5)
    ys = [rng.randint(0, 1) for _ in range(200)]
    ps = [rng.random() for _ in range(200)]
    a = M.ranking_metrics(_df(spark, ys, ps)).first()["roc_auc"]
    b = M.ranking_metrics(_df(spark, ys, [p ** 3 for p in ps])).first()["roc_auc"]
    assert a == pytest.approx(b, abs=1e-12)


def test_roc_curve_drops_collinear_points(spark):
    ys = [1, 1, 0, 0, 1, 0]
    ps = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]
    rows = sorted(M.roc_curve(_df(spark, ys, ps)).collect(), key=lambda r: -r["threshold"])
    fpr = [r["fpr"] for r in rows]
    tpr = [r["tpr"] for r in rows]
    # sklearn (drop_intermediate=True) keeps the corners; (2/3 fpr at 0.6) is collinear
    exp = [(0, 0), (0, 1 / 3), (0, 2 / 3), (2 / 3, 2 / 3), (2 / 3, 1), (1, 1)]
    assert fpr == pytest.approx([a for a, _ in exp]) and tpr == pytest.approx([b for _, b in exp])
    assert math.isinf(rows[0]["threshold"])


def test_prefix_sums_partition_independent(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 3), rng.random(), rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g int, s double, v long")
    res = []
    for parts in (1, 3, 17):
        out = prefix_sums(df.repartition(parts), [F.col("s").desc(), F.col("k")], ["v"], ["g"], partitions=parts)
        res.append(sorted((r["k"], r["cum_v"]) for r in out.collect()))
    assert res[0] == res[1] == res[2]
    exp = {}
    for g in range(4):
        acc = 0
        for k, _, s, v in sorted([r for r in rows if r[1] == g], key=lambda r: (-r[2], r[0])):
            acc += v
            exp[k] = acc
    assert dict(res[0]) == exp


def test_global_rank_dense(spark):
    df = spark.range(0, 1000).withColumn("s", (F.col("id") * 7919) % 101)
    r = global_rank(df, [F.col("s"), F.col("id")]).select("rank").collect()
    assert sorted(x[0] for x in r) == list(range(1000))


def test_calibration_bins_edges(spark):
    ps = [0.0, 0.1, 0.1000001, 0.3, 0.5, 0.99, 1.0]
    df = _df(spark, [0, 1, 0, 1, 0, 1, 1], ps)
    bins = [r["b"] for r in df.select(M.uniform_bin("score", 10).alias("b")).collect()]
    edges = np.linspace(0.0, 1.0, 11)
    assert bins == list(np.searchsorted(edges[1:-1], ps))
    assert bins == [0, 0, 1, 2, 4, 9, 9]


def test_lift_bins_equal_quantile_cut(spark):
    n, b = 103, 10
    rng = random.Random(11)
    ys = [rng.randint(0, 1) for _ in range(n)]
    ps = [rng.random() for _ in range(n)]
    lt = {r["bin"]: r for r in M.lift_table(_df(spark, ys, ps), bins=b).collect()}
    order = sorted(range(n), key=lambda i: (-ps[i], i))
    edges = np.quantile(np.arange(n), np.linspace(0, 1, b + 1))
    bin_of = np.clip(np.searchsorted(edges, np.arange(n), side="left") - 1, 0, b - 1)
    for k in range(b):
        members = [order[r] for r in range(n) if bin_of[r] == k]
        assert lt[k]["n"] == len(members)
        assert lt[k]["actual"] == pytest.approx(sum(ys[i] for i in members) / len(members))
    one = M.lift_table(_df(spark, ys, ps), bins=1).first()
    assert one["lift"] == pytest.approx(1.0) and one["cumulative_lift"] == pytest.approx(1.0)


def test_threshold_sweep_matches_brute_force(spark):
    rng = random.Random(2)
    ys = [rng.randint(0, 1) for _ in range(400)]
    ps = [rng.choice([0.1, 0.17, 0.5, 0.89, 0.9, 1.0, 0.0]) if i % 3 == 0 else rng.random() for i in range(400)]
    sw = {r["i"]: r for r in M.threshold_sweep(_df(spark, ys, ps)).collect()}
    grid = np.arange(0.1, 0.9, 0.01)
    assert len(sw) == len(grid) == 80
    for i, t in enumerate(grid):
        tp = sum(1 for y, p in zip(ys, ps) if p > t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p > t and y == 0)
        fn = sum(ys) - tp
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        assert sw[i]["threshold"] == t
        assert sw[i]["f1"] == pytest.approx(f1, abs=1e-12)
    best = M.best_threshold(M.threshold_sweep(_df(spark, ys, ps))).first()
    f1s = [sw[i]["f1"] for i in range(80)]
    assert best["i"] == int(np.argmax(f1s))


def test_one_class_table(spark):
    df = _df(spark, [1, 1, 1], [0.2, 0.7, 0.9]).withColumn("decision", (F.col("score") > 0.5).cast("int"))
    m = M.binary_metrics(df).first()
    assert m["precision"] == 1.0 and m["recall"] == pytest.approx(2 / 3)
    cd = M.class_distribution(df).first()
    assert math.isinf(cd["imbalance_ratio"]) and cd["entropy"] == 0.0 and cd["uniformity"] == 0.0
    cw = M.class_weights(df).first()
    assert cw["weight"] == 1.0


def test_classification_report_and_confusion(spark):
    ys = [0, 0, 1, 1, 1, 0]
    ds = [0, 1, 1, 0, 1, 0]
    df = spark.createDataFrame(list(zip(ys, ds)), "label int, decision int")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert rep["1"]["precision"] == pytest.approx(2 / 3) and rep["0"]["support"] == 3
    assert rep["accuracy"]["f1"] == pytest.approx(4 / 6)


def test_log_loss_clips(spark):
    df = _df(spark, [1, 0], [0.0, 1.0])
    g = M.calibration_gain(df.withColumn("calibrated", F.lit(0.5)), "label", "score", "calibrated").first()
    assert g["log_loss_before"] == pytest.approx(-math.log(M.LOG_LOSS_EPS))
    assert g["brier_before"] == 1.0 and g["brier_after"] == 0.25


def test_hot_score_is_split_across_range_partitions(spark):
    # a third of the rows share one score: ties broken by key keep the order
    # total, so the sampled range partitioner spreads the hot value
    df = spark.range(0, 30000).withColumn("s", F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.rand(1)))
    sizes = (df.repartitionByRange(8, F.col("s").desc(), F.col("id"))
             .groupBy(F.spark_partition_id().alias("p")).count().collect())
    counts = [r["count"] for r in sizes]
    assert len(counts) == 8 and max(counts) < 2 * 30000 / 8
    ranks = global_rank(df, [F.col("s").desc(), F.col("id")], partitions=8).select("rank").collect()
    assert sorted(r[0] for r in ranks) == list(range(30000))


def test_lift_bin_by_key_literal_form(spark):
    n = 50
    ys = [i % 2 for i in range(n)]
    ps = [(i * 37 % 50) / 50 for i in range(n)]
    lt = {r["bin"]: r for r in M.lift_table(_df(spark, ys, ps), bins=5, bin_by="key").collect()}
    edges = np.quantile(np.arange(n), np.linspace(0, 1, 6))
    bin_of = np.clip(np.searchsorted(edges, np.arange(n), side="left") - 1, 0, 4)
    for k in range(5):
        members = [i for i in range(n) if bin_of[i] == k]
        assert lt[k]["n"] == len(members)
        assert lt[k]["predicted_proba"] == pytest.approx(sum(ps[i] for i in members) / len(members))


def test_one_class_zero_means_and_null_scores(spark):
    for label in (0, 1):
        df = spark.createDataFrame([(i, label, 0.1 * i) for i in range(5)], "event_id long, label int, score double")
        e = M.evaluate(df).first()
        assert e["roc_auc"] is None and e["tp"] + e["fp"] + e["fn"] + e["tn"] == 5
        assert (e["pr_auc"] is None) == (label == 0)
        assert all(r["fpr"] is None for r in M.roc_curve(df).where("threshold < 1").collect()) == (label == 1)
        lift = M.lift_table(df).collect()
        assert all((r["lift"] is None) == (label == 0) for r in lift)
        assert M.pr_curve(df).count() == 6
    folds = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.2), (1, 1, 0.7), (1, 1, 0.4), (None, 0, 0.3), (None, 1, 0.6)], "fold int, label int, score double")
    fm = {r["fold"]: r for r in M.fold_metrics(folds).collect()}
    assert fm[0]["roc_auc"] == 1.0 and fm[1]["roc_auc"] is None
    zero = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)], "fold int, f1 double, precision double, recall double")
    assert all(r["mean"] == 0 and r["cv"] is None for r in M.fold_stability(zero).collect())
    perfect = spark.createDataFrame([(1, 1.0, 0.9), (0, 0.0, 0.1)], "label int, score double, calibrated double")
    assert M.calibration_gain(perfect).first()["brier_improvement_pct"] is None
    nulls = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (None, 0.5)], "label int, score double")
    e = M.evaluate(nulls).first()
    assert e["tp"] + e["fp"] + e["fn"] + e["tn"] == 2 and e["roc_auc"] == 1.0
