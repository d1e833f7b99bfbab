"""Models: scoring chain, calibration range, bundle round trip, stream = batch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postsignal.operators import train as TR
from postsignal.operators.calibrate import calibrated_probability, fit_calibrator
from postsignal.operators.embed import apply_pca, fit_pca
from postsignal.plans.features import all_features, fit_features
from postsignal.plans.scoring import score_one, score_posts
from postsignal.sources import fixtures as FX
from postsignal.sources import io as IO
from postsignal.sources.bundle import Bundle, load_bundle, save_bundle
from postsignal.streaming.scoring import score_stream

PARAMS = {"n_estimators": 5, "max_depth": 3, "min_child_samples": 2, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def trained(spark, sf_small):
    posts = FX.with_emotions(FX.with_attributes(FX.posts(spark, sf_small)))
    posts = posts.withColumn("label", (F.col("total_trade_volume") >= 50).cast("int"))
    st = fit_features(posts)
    df = all_features(posts, st, passthrough=["label"]).withColumn("fold", (F.col("post_id") % 3).cast("int"))
    cols = [c for c in df.columns if c not in ("post_id", "label", "fold")]
    spec = TR.fit_spec(df, cols)
    model = TR.fit_model(df, spec, PARAMS)
    return posts, df, spec, model, st


def test_probabilities_with_missing_values(trained):
    posts, df, spec, model, _ = trained
    assert "text_quoted_ratio" in spec.nullable               # null when a text is empty; the trees learn its side
    p = TR.probability(model, df, spec).select("p").collect()
    assert len(p) == df.count() and all(0.0 <= r[0] <= 1.0 for r in p)
    assert set(TR.probability(model, df, spec).columns) == set(df.columns) | {"p"}


def test_calibrated_in_unit_interval(trained):
    posts, df, spec, model, _ = trained
    cal = fit_calibrator(df, spec, PARAMS, "label", "fold", "sigmoid")
    out = calibrated_probability(df, cal, spec).select("calibrated").collect()
    assert all(0.0 <= r[0] <= 1.0 for r in out)
    iso = fit_calibrator(df, spec, PARAMS, "label", "fold", "isotonic")
    out = calibrated_probability(df, iso, spec).select("calibrated").collect()
    assert all(0.0 <= r[0] <= 1.0 for r in out)


def test_bundle_round_trip_and_stream_equals_batch(spark, trained):
    posts, df, spec, model, st = trained
    b = Bundle(model=model, spec=spec, threshold=0.4, categories=st.categories)
    root = tempfile.mkdtemp(prefix="ps-test-")
    save_bundle(spark, b, os.path.join(root, "bundle"))
    loaded = load_bundle(spark, os.path.join(root, "bundle"))
    assert loaded.threshold == 0.4 and loaded.spec.columns == spec.columns
    batch = {r["post_id"]: r["probability"] for r in score_posts(posts, b).collect()}
    again = {r["post_id"]: r["probability"] for r in score_posts(posts, loaded).collect()}
    assert batch == again
    src = os.path.join(root, "in")
    posts.write.parquet(src)
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (score_stream(stream, loaded).writeStream.format("parquet")
         .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True)
         .start(os.path.join(root, "out")))
    q.awaitTermination()
    streamed = {r["post_id"]: r["probability"] for r in spark.read.parquet(os.path.join(root, "out")).collect()}
    assert streamed == batch
    assert load_bundle(spark, os.path.join(root, "absent")) is None


def test_score_one_unavailable_image_and_no_model(spark, sf_small, trained):
    posts, df, spec, model, st = trained
    b = Bundle(model=model, spec=spec, categories=st.categories)
    row = {"post_id": 1, "text": "Hello WORLD!!!", "quoted_text": None, "tweet_type": "SINGLE",
           "image_url": "https://example.com/missing.jpg", "created_at": "2024-01-02T03:04:05"}
    images = IO.image_table_from_pages(FX.table(spark, sf_small, "pages"))
    assert score_one(spark, b, row, images) == (False, 0.0)
    assert score_one(spark, None, row) == (False, 0.0)
    ok, p = score_one(spark, b, {**row, "image_url": None}, images)
    assert 0.0 <= p <= 1.0


def test_pca_centred_and_fallbacks(spark, sf_small):
    emb = FX.table(spark, sf_small, "embeddings")
    st = fit_pca(emb, "embedding", 5)
    out = apply_pca(emb, st, "embedding", "pc").select("pc").collect()
    import numpy as np
    m = np.array([r[0] for r in out])
    assert m.shape[1] == 5 and np.allclose(m.mean(axis=0), 0.0, atol=1e-9)   # centred scores
    one = emb.orderBy("vec_id").limit(1)
    st1 = fit_pca(one, "embedding", 60)
    r = apply_pca(one, st1, "embedding", "pc").first()
    assert st1.mode == "slice" and len(r["pc"]) == 60
    assert r["pc"][:5] == pytest.approx([float(x) for x in r["embedding"][:5]])
    st0 = fit_pca(one.where("false"), "embedding", 60)
    assert st0.mode == "zeros"


def test_full_catalogue_has_181_features(spark, sf_small):
    from postsignal.functions.models import make_byte_histogram_model
    from postsignal.plans.vector_features import fit_vector_state, vector_features
    posts = FX.with_emotions(FX.with_attributes(FX.posts(spark, sf_small)))
    images = FX.images(spark, sf_small)
    st = fit_vector_state(posts, images, make_byte_histogram_model, dim=64)
    vec = vector_features(posts, st, images, make_byte_histogram_model)
    full = all_features(posts, fit_features(posts)).join(vec, "post_id", "left")
    assert len(full.columns) == 1 + 181
    rows = full.select("quoted_text_length", "main_quoted_contrast", "perplexity_score", "has_image",
                       "clip_emb_0").collect()
    assert all(r["main_quoted_contrast"] == 0.0 for r in rows if r["quoted_text_length"] == 0)
    assert all(r["perplexity_score"] >= 0.0 for r in rows)
    assert all(r["clip_emb_0"] == 0.0 for r in rows if r["has_image"] == 0)


def test_vector_bundle_round_trip_stream(spark, sf_small):
    from postsignal.functions.models import make_byte_histogram_model
    from postsignal.plans.vector_features import VECTOR_COLUMNS, fit_vector_state, with_vector_features
    posts = FX.with_emotions(FX.with_attributes(FX.posts(spark, sf_small)))
    images = FX.images(spark, sf_small)
    vst = fit_vector_state(posts, images, make_byte_histogram_model, dim=32)
    st = fit_features(posts)
    lab = posts.withColumn("label", (F.col("total_trade_volume") >= 50).cast("int"))
    df = all_features(with_vector_features(lab, vst, images, make_byte_histogram_model), st,
                      passthrough=["label"] + VECTOR_COLUMNS)
    cols = [c for c in df.columns if c not in ("post_id", "label")]
    spec = TR.fit_spec(df, cols)
    b = Bundle(model=TR.fit_model(df, spec, PARAMS), spec=spec, categories=st.categories, vectors=vst)
    root = tempfile.mkdtemp(prefix="ps-vec-")
    save_bundle(spark, b, os.path.join(root, "b"))
    loaded = load_bundle(spark, os.path.join(root, "b"))
    assert loaded.vectors is not None and loaded.vectors.text_pca.mode == "pca"
    batch = {r["post_id"]: r["probability"] for r in
             score_posts(posts, b, images, make_image_model=make_byte_histogram_model).collect()}
    again = {r["post_id"]: r["probability"] for r in
             score_posts(posts, loaded, images, make_image_model=make_byte_histogram_model).collect()}
    assert batch.keys() == again.keys()
    assert all(abs(batch[k] - again[k]) < 1e-9 for k in batch)
    src = os.path.join(root, "in")
    posts.write.parquet(src)
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (score_stream(stream, loaded, images, make_image_model=make_byte_histogram_model).writeStream
         .format("parquet").option("checkpointLocation", os.path.join(root, "ck")).trigger(availableNow=True)
         .start(os.path.join(root, "out")))
    q.awaitTermination()
    streamed = {r["post_id"]: r["probability"] for r in spark.read.parquet(os.path.join(root, "out")).collect()}
    assert streamed.keys() == batch.keys() and all(abs(streamed[k] - batch[k]) < 1e-9 for k in batch)


def test_emotions_from_text_in_bundle_batch_single_and_stream(spark, sf_small, trained):
    from postsignal.plans.catalog_ml import _emotion_state
    from postsignal.plans.emotions import with_emotion_scores
    _, df, spec, model, st = trained
    posts = FX.posts(spark, sf_small)                    # no emotion columns: they come from the text
    state = _emotion_state(spark, posts)
    blank = spark.createDataFrame([(1, " "), (2, None), (3, "the joy of fear")], "post_id long, text string")
    rows = {r["post_id"]: [v for k, v in r.asDict().items() if k.startswith("emotion_")] for r in with_emotion_scores(blank, state).collect()}
    assert rows[1] == rows[2] == [0.0] * 11 and all(0 <= v <= 1 for v in rows[3]) and sum(rows[3]) > 0
    root = tempfile.mkdtemp(prefix="ps-test-")
    save_bundle(spark, Bundle(model=model, spec=spec, categories=st.categories, emotions=state), os.path.join(root, "b"))
    loaded = load_bundle(spark, os.path.join(root, "b"))
    assert loaded.emotions.weights == state.weights
    batch = {r["post_id"]: r["probability"] for r in score_posts(posts, loaded).collect()}
    first = posts.orderBy("post_id").first()
    assert score_one(spark, loaded, first.asDict())[1] == pytest.approx(batch[first["post_id"]], abs=1e-12)
    posts.write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(posts.schema).parquet(os.path.join(root, "in"))
    q = (score_stream(stream, loaded).writeStream.format("parquet").option("checkpointLocation", os.path.join(root, "c"))
         .trigger(availableNow=True).start(os.path.join(root, "out")))
    q.awaitTermination()
    assert {r["post_id"]: r["probability"] for r in spark.read.parquet(os.path.join(root, "out")).collect()} == batch


def test_the_registered_queries_ask_for_the_whole_budget(monkeypatch):
    from contextlib import contextmanager

    import postsignal.plans.catalog_ml as C
    from postsignal.operators.boost import Params
    from postsignal.operators.search import JOINT_PATIENCE, SEARCH_ROUNDS
    from postsignal.operators.split import learning_fractions
    assert Params.of(C.PARAMS) == Params() and (SEARCH_ROUNDS, JOINT_PATIENCE, TR.PATIENCE) == (500, 20, 50)
    asked = {}

    @contextmanager
    def frame(spark, sf_dir, target=50.0):
        yield None, []
    monkeypatch.setattr(C, "_train_frame", frame)
    monkeypatch.setattr(C, "_spec", lambda df, cols: None)
    monkeypatch.setattr(C, "learning_curve", lambda *a, **kw: asked.update(kw))
    C.learning_curve_query(None, "")
    assert len(asked.get("fractions") or learning_fractions()) == 15 and asked["params"] == C.PARAMS
    import inspect

    from postsignal.operators.search import joint_search, subset_search
    from postsignal.plans.training import TrainConfig
    assert inspect.signature(subset_search).parameters["trials"].default == 50
    assert [inspect.signature(joint_search).parameters[k].default for k in ("outer", "inner", "trials", "rounds")] == [3, 5, 30, 500]
    assert (TrainConfig().joint_trials, TrainConfig().subset_trials) == (30, 50)


def test_pca_works_out_its_vectors_once(spark):
    """Mean and covariance read kept vectors: the expensive step below them runs once a row."""
    from pyspark.sql import functions as F

    from postsignal.operators.embed import fit_pca
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        seen.add(1)
        return [float(i), float(i * i % 7), float(i % 3)]

    rows = spark.range(200, numPartitions=1).select(vector("id").alias("v"))
    state = fit_pca(rows, "v", 2)
    assert state.mode == "pca" and len(state.mean) == 3 and seen.value == 200
    assert not spark.sparkContext._jsc.getPersistentRDDs()
