"""Nested folds and scoring of several sets of trials."""

from pyspark.sql import functions as F

from postsignal.operators.boost import Params, fit_batch, bin_rows
from postsignal.operators.search import _fold_place, _nested_folds, trial_scores
from postsignal.operators.split import stratified_folds
from postsignal.operators.train import fold_fits


def _rows(spark):
    key = F.col("id") % 290                                       # some keys twice
    return spark.range(300).select(key.alias("k"), (F.xxhash64(key) % 3 == 0).cast("int").alias("y"), F.col("id").alias("x"))


def test_inner_folds_are_those_of_the_outer_training_rows(spark):
    df = _rows(spark)
    got = _nested_folds(df, "y", "k", 3, 5, 42).checkpoint()
    assert got.count() == 300
    outer = stratified_folds(df, "y", "k", 3, 42, out="_outer")
    key = lambda t: sorted(map(tuple, t.collect()))
    assert key(got.select("x", "_outer")) == key(outer.select("x", "_outer"))
    for o in range(3):
        mine = stratified_folds(outer.where(F.col("_outer") != o), "y", "k", 5, 42 + o, out="_in")
        assert key(got.where(f"_outer <> {o}").select("x", f"_inner{o}")) == key(mine.select("x", "_in"))
        assert got.where(f"_outer = {o} and _inner{o} <> -1").count() == 0


def test_several_sets_score_as_each_alone(spark):
    df = _nested_folds(_rows(spark), "y", "k", 2, 3, 1).withColumn("z", F.col("x") % 7 + F.col("y") * 2).checkpoint()
    p = Params.of({"n_estimators": 10, "learning_rate": 0.5, "min_data_in_leaf": 5})
    sets = []
    with bin_rows(df, ["x", "z"], "y", "k", ["_outer", "_inner0", "_inner1"]) as store:
        for o in (0, 1):
            fits = fold_fits([0, 1, 2], f"_inner{o}", p, None, 0, ["z"], (("_outer", "!=", float(o)),))
            sets.append((_fold_place([0, 1, 2], f"_inner{o}"), [fit_batch(store, fits)]))
    for metric in ("f1", "pr_auc"):
        both = trial_scores(df, "y", sets, metric)
        alone = [trial_scores(df.where(F.col("_outer") != o), "y", [s], metric)[0] for o, s in enumerate(sets)]
        assert both == alone and all(0 < v <= 1 for row in both for v in row)
    assert trial_scores(df, "y", [(F.lit(None).cast("int"), [])], "f1") == [[]]
