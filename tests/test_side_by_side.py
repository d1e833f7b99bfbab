"""Calls side by side, tables kept in few tasks, resampled parts worked out once."""

import os
import threading

import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from postsignal.operators.calibrate import SigmoidCalibrator, fit_calibrator
from postsignal.operators.train import FeatureSpec, train_folds
from postsignal.session import drop_checkpoint, few_tasks, settled, side_by_side


def test_a_resampled_part_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        seen.add(1)
        return float(x)

    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("fold"),
                                 (F.col("id") % 11).cast("double").alias("x"))
    res = train_folds(df, FeatureSpec(["x"]), {"n_estimators": 2}, "y", "fold", key="k", resample=lambda part: part.withColumn("x", costly("x")))
    assert res.metrics.count() == 4 and seen.value == 3 * 200


def test_side_by_side_keeps_the_order_and_runs_at_a_time(spark):
    both = threading.Barrier(2, timeout=60)
    assert side_by_side([lambda i=i: (both.wait(), spark.range(i + 1).count())[1] for i in range(4)], most=2) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        side_by_side([lambda: spark.range(3).count(), lambda: [].index(1)])


def test_a_settled_table_has_few_tasks_and_its_files_go(spark):
    df = settled(spark.range(1000).repartition(60).withColumn("z", F.col("id") * 2))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.agg(F.sum("z")).first()[0] == 999_000
    assert settled(spark.range(20_000, numPartitions=2)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert few_tasks(spark.range(5, numPartitions=1)).rdd.getNumPartitions() == 1
    kept = spark.range(10).checkpoint()
    path = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    drop_checkpoint(kept)
    assert not os.path.exists(path)


def test_the_folds_calibrators_are_fitted_at_a_time_and_by_few_tasks(spark):
    both, tasks = threading.Barrier(2, timeout=60), []

    class Waiting(SigmoidCalibrator, Estimator):
        def _fit(self, df):
            tasks.append(df.rdd.getNumPartitions())
            both.wait()
            return super()._fit(df)

    df = spark.range(240).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("fold"),
                                 (F.col("id") % 11).cast("double").alias("x")).repartition(40).checkpoint()
    cal = fit_calibrator(df, FeatureSpec(["x"]), {"n_estimators": 3}, "y", "fold", Waiting(), key="k")
    assert len(cal.stages) == 2 and max(tasks) <= spark.sparkContext.defaultParallelism
