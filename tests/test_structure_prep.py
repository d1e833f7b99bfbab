"""Structure, attribute, emotion columns; preprocessing and correlation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postsignal.functions import structure as S
from postsignal.functions import vectors as V
from postsignal.operators import correlation as C
from postsignal.operators import prep as P


def test_one_hot_media_quote_temporal(spark):
    rows = [(1, "hi there", None, "QUOTE", "https://x/amplify_video/1.mp4", "2024-01-06T10:15:00"),
            (2, "", "quoted", None, "", "2024-01-01T23:59:59"),
            (3, "abc", "abcdef", "SINGLE", "https://x/img.jpg", "2024-01-07T00:00:00")]
    df = spark.createDataFrame(rows, "post_id long, text string, quoted_text string, tweet_type string, "
                                     "image_url string, created_at string")
    cats = S.fit_categories(df, "tweet_type")
    assert cats == ["QUOTE", "SINGLE"]
    out = {r["post_id"]: r for r in S.structure(df, cats).collect()}
    assert (out[2]["tweet_type_QUOTE"], out[2]["tweet_type_SINGLE"]) == (0, 0)       # null -> all zero
    assert out[1]["media_type_video"] == 1 and out[1]["media_type_image"] == 0
    assert out[2]["media_type_only_text"] == 1 and out[2]["has_image"] == 0
    assert out[3]["media_type_image"] == 1
    assert out[1]["text_quoted_ratio"] is None and out[2]["text_quoted_ratio"] is None
    assert out[3]["text_quoted_ratio"] == 0.5 and out[3]["has_quoted_text"] == 1
    # 2024-01-06 is a Saturday, 2024-01-01 a Monday
    assert (out[1]["day_of_week"], out[1]["is_weekend"], out[1]["hour"]) == (5, 1, 10)
    assert (out[2]["day_of_week"], out[2]["is_weekend"], out[2]["hour"]) == (0, 0, 23)
    assert out[3]["day_of_week"] == 6


def test_attributes_and_eid(spark):
    vals = {f"EM{i}": i / 20 for i in range(1, 12)}
    vals["EM2"] = 0.9
    df = spark.createDataFrame([(1, vals), (2, None), (3, {"SS1": 0.5})],
                               "post_id long, attributes map<string,double>")
    out = {r["post_id"]: r for r in df.select("post_id", S.eid().alias("eid"), *S.attribute_columns()).collect()}
    others = [vals[f"EM{i}"] for i in range(1, 12) if i != 4]
    exp = (sum(others) - vals["EM4"]) * max(others) / math.sqrt(1 + sum(v > 0.7 for v in others))
    assert out[1]["eid"] == pytest.approx(exp)
    assert out[2]["eid"] == 0.0 and out[2]["CT8"] == 0.0          # missing map -> zeros
    assert out[3]["SS1"] == 0.5 and out[3]["EM1"] == 0.0


def test_emotion_summary_zero_sum(spark):
    cols = {f"emotion_{e}": 0.0 for e in S.EMOTION_LABELS}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} double" for k in cols))
    r = df.select(*S.emotion_summary_columns()).first()
    assert r["emotional_valence"] == 0.0 and r["emotional_intensity"] == 0.0


def test_vector_contrast_and_default(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0], True), (2, [0.0, 0.0], [1.0, 1.0], True),
                                (3, [1.0, 2.0], None, False)],
                               "id int, a array<double>, b array<double>, q boolean")
    out = {r["id"]: r for r in df.select("id", *V.contrast_columns("a", "b", F.col("q"))).collect()}
    assert out[1]["main_quoted_contrast"] == pytest.approx(1.0)
    assert out[1]["internal_diversity"] == pytest.approx(0.8)
    assert out[2]["main_quoted_contrast"] == 0.0 and out[3]["combined_diversity"] == 0.0
    d = df.select(V.vector_default("a", 4).alias("v"), V.vector_default("b", 1).alias("w")).collect()
    assert d[2]["v"] == [1.0, 2.0, 0.0, 0.0] and d[2]["w"] == [0.0]


def test_scaler_population_std_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "x double, c double")
    st = P.fit_scaler(df, ["x", "c"])
    zx = np.array([1.0, 0.0, 3.0])
    assert st.mean["x"] == pytest.approx(zx.mean()) and st.std["x"] == pytest.approx(zx.std())
    assert st.std["c"] == 1.0
    out = P.apply_scaler(df, st).collect()
    assert out[1]["x"] is None and out[0]["c"] == 0.0


def test_fill_all_null_and_profile(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert P.all_null_columns(df) == ["b"]
    filled = P.fill_all_null(df).collect()
    assert filled[0]["b"] == 0.0 and filled[1]["a"] is None
    prof = {r["column"]: r["nulls"] for r in P.null_profile(df).collect()}
    assert prof == {"a": 1, "b": 2, "__total__": 3}


def test_gram_matches_aggregate_corr(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 14))
    x[:, 3] = x[:, 2] * 2 + rng.normal(scale=0.01, size=400)
    x[rng.random((400, 14)) < 0.1] = np.nan
    x[:, 7] = 1.0
    cols = [f"c{i}" for i in range(14)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    g = {(r.a, r.b): r.corr for r in C.pairwise_corr(df, cols).collect()}
    want = pd.DataFrame(x, columns=cols).corr()             # pairwise complete
    assert len(g) == 14 * 13 // 2
    for (p, q), v in g.items():
        if np.isnan(want.loc[p, q]):
            assert v is None, (p, q)
        else:
            assert v == pytest.approx(want.loc[p, q], abs=1e-10), (p, q)


def test_correlation_drop_is_not_iterative(spark):
    # a~b and b~c strongly, a~c weakly: b and c are both dropped (c because of b)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=2000), rng.normal(size=2000)
    a = x                                                # angles 0, 30 and 60 degrees
    b = np.cos(np.pi / 6) * x + np.sin(np.pi / 6) * y
    c = np.cos(np.pi / 3) * x + np.sin(np.pi / 3) * y
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    corr = C.pairwise_corr(df, ["a", "b", "c"])
    m = {(r.a, r.b): abs(r.corr) for r in corr.collect()}
    assert m[("a", "b")] > 0.8 and m[("b", "c")] > 0.8 and m[("a", "c")] < 0.8
    assert C.dropped_features(corr, ["a", "b", "c"], 0.8) == ["b", "c"]
