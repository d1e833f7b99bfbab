"""Vectors written as text by the vector queries; rows dealt anew by the fingerprint query."""

from pyspark.sql import functions as F

from postsignal.plans.catalog_ml import _dealt, _numbers


def test_components_are_written_with_six_decimals(spark):
    df = spark.createDataFrame([(1, [0.0, -0.0, 1234.5, -0.0000004, 0.1234567, None]), (2, []), (3, None)], "id int, v array<double>")
    got = {r["id"]: r["vector"] for r in df.select("id", _numbers(F.col("v"))).collect()}
    assert got == {1: "0.000000,0.000000,1234.500000,0.000000,0.123457", 2: "", 3: None}


def test_float_vectors_too(spark):
    df = spark.createDataFrame([([0.5, -0.25],)], "v array<float>").select(_numbers("v"))
    assert df.first()["vector"] == "0.500000,-0.250000"


def test_fingerprint_deals_rows_to_all_tasks_of_a_shuffle(spark):
    df = spark.range(1000)
    dealt = _dealt(spark, df)
    assert dealt.rdd.getNumPartitions() == 8 and dealt.count() == 1000
