"""Splits, folds, learning subsets, sampling and balancing: properties."""

import pytest
from pyspark.sql import functions as F

from postsignal.operators import balance as B
from postsignal.operators import split as SP


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.range(0, 997).select(F.col("id").alias("k"), ((F.col("id") * 37) % 10 < 3).cast("int").alias("y"))
    return df


def test_split_disjoint_complete_and_exact(spark, labelled):
    s = SP.stratified_split(labelled, "y", "k", 0.2, 42)
    train, test = SP.complement(s)
    tr = {r["k"] for r in train.select("k").collect()}
    te = {r["k"] for r in test.select("k").collect()}
    assert not tr & te and len(tr | te) == 997
    assert len(te) == 200                                   # ceil(0.2 * 997)
    counts = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    tcounts = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    for c, n in counts.items():
        assert abs(tcounts[c] - n * 200 / 997) < 1


def test_split_independent_of_partitioning(spark, labelled):
    a = SP.stratified_split(labelled.repartition(1), "y", "k", 0.2, 42).where("is_test").select("k")
    b = SP.stratified_split(labelled.repartition(13), "y", "k", 0.2, 42).where("is_test").select("k")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


def test_fold_sizes_differ_by_at_most_one(spark, labelled):
    f = SP.stratified_folds(labelled, "y", "k", 5, 42)
    sizes = {}
    for r in f.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    for v in sizes.values():
        assert len(v) == 5 and max(v) - min(v) <= 1


def test_fold_count_lowered_and_guard(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(20)], "k long, y int")
    f = SP.stratified_folds(df, "y", "k", 5, 42)
    assert f.select("fold").distinct().count() == 3
    one = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "k long, y int")
    with pytest.raises(ValueError):
        SP.stratified_folds(one, "y", "k", 5, 42)


def test_learning_subsets_nested_prefixes(spark, labelled):
    f = SP.stratified_folds(labelled, "y", "k", 5, 42)
    sub = SP.learning_subsets(f, "k", "fold", 5, [0.1, 0.5, 1.0]).where("split = 0").collect()
    train_keys = sorted(r["k"] for r in f.where("fold != 0").collect())
    sizes = SP.train_sizes(len(train_keys), [0.1, 0.5, 1.0])
    for i, n in enumerate(sizes):
        members = sorted(r["k"] for r in sub if r["size_idx"] <= i)
        assert members == train_keys[:n]


def test_seeded_sample_deterministic(spark, labelled):
    a = [r["k"] for r in SP.seeded_sample(labelled.repartition(2), 50, "k", 7).collect()]
    b = [r["k"] for r in SP.seeded_sample(labelled.repartition(9), 50, "k", 7).collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 50     # the rows are the sample; a table has no order


def test_oversample_exact_counts_and_copies(spark, labelled):
    o = B.oversample(labelled, "y", "k", 42)
    counts = {r["y"]: r["count"] for r in o.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == max(counts.values())
    orig = {r["k"]: r["y"] for r in labelled.collect()}
    for r in o.where("copy > 0").collect():
        assert orig[r["k"]] == r["y"]                       # added rows are copies of same-class rows
    per_row = [r["count"] for r in o.where("y = 1").groupBy("k").count().collect()]
    assert max(per_row) - min(per_row) <= 1                 # copies spread evenly


def test_undersample_and_weights(spark, labelled):
    u = B.undersample(labelled, "y", "k", 42)
    counts = {r["y"]: r["count"] for r in u.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == min(r["count"] for r in labelled.groupBy("y").count().collect())
    w = {r["y"]: r["weight"] for r in B.with_class_weight(labelled, "y").select("y", "weight").distinct().collect()}
    n1 = labelled.where("y = 1").count()
    assert w[1] == pytest.approx(997 / (2 * n1))


def test_copies_stay_together_and_rows_do_not_multiply(spark, labelled):
    o = B.oversample(labelled, "y", "k", 42)
    n = o.count()
    s = SP.stratified_split(o, "y", "k", 0.2, 42)
    f = SP.stratified_folds(o, "y", "k", 5, 42)
    assert s.count() == n and f.count() == n and s.columns == [*o.columns, "is_test"]
    assert s.groupBy("k").agg(F.countDistinct("is_test").alias("d")).where("d > 1").count() == 0
    assert f.groupBy("k").agg(F.countDistinct("fold").alias("d")).where("d > 1").count() == 0
    assert s.where("is_test").select("y", "k").distinct().count() == 200


def test_sampling_ratio(spark, labelled):
    n = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    size = lambda df: {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert size(B.oversample(labelled, "y", "k", 42, ratio=0.8)) == {0: n[0], 1: int(0.8 * n[0])}
    assert size(B.undersample(labelled, "y", "k", 42, ratio=0.5)) == {0: int(n[1] / 0.5), 1: n[1]}
    assert size(B.oversample(labelled, "y", "k", 42, ratio={1: 450})) == {0: n[0], 1: 450}


def test_many_copies_are_made_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(B, "COPY_CHUNK", 7)
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(40)], "k long, y int")
    o = B.oversample(df, "y", "k", 42)
    assert sorted(r["copy"] for r in o.where("y = 1").collect()) == list(range(39))


def test_hash_buckets_do_not_change_the_ranks(spark, labelled, monkeypatch):
    one = {r["k"]: r["r"] for r in SP.class_rank(labelled, "y", "k", 42, out="r").collect()}
    monkeypatch.setattr(SP, "BUCKET_ROWS", 20)
    many = {r["k"]: r["r"] for r in SP.class_rank(labelled, "y", "k", 42, out="r").collect()}
    for c in (0, 1):
        keys = [r["k"] for r in labelled.where(F.col("y") == c).collect()]
        assert sorted(many[k] for k in keys) == sorted(one[k] for k in keys) == list(range(len(keys)))
    nulls = spark.createDataFrame([(1, None), (2, None), (3, 0)], "k long, y int")
    assert sorted((r["y"] is None, r["r"]) for r in SP.class_rank(nulls, "y", "k", 42, out="r").collect()) == [(False, 0), (True, 0), (True, 1)]


def test_balance_skip_band_and_unknown(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "k long, y int")
    assert B.balance(df, "y", "k", "oversample") is df       # ratio 1 is inside [0.5, 2]
    skewed = spark.createDataFrame([(i, int(i < 2)) for i in range(10)], "k long, y int")
    assert B.balance(skewed, "y", "k", "unheard of") is skewed


def test_seeded_sample_equals_the_sorted_prefix(spark):
    from postsignal.operators.split import hash_order
    df = spark.range(20_000).withColumnRenamed("id", "k")
    for n in (0, 1, 37, 5000, 19_999, 20_000, 30_000):
        want = {r["k"] for r in df.orderBy(hash_order("k", 7), "k").limit(n).collect()}
        assert {r["k"] for r in SP.seeded_sample(df, n, "k", 7).collect()} == want
    hot = spark.range(12_000).select((F.col("id") % 3 * (F.col("id") > 9000).cast("long")).alias("k"))      # one key has most rows
    for n in (5, 4000, 11_500):
        assert SP.seeded_sample(hot, n, "k", 7).count() == n
    assert SP.seeded_sample(df.limit(0), 5, "k").count() == 0
