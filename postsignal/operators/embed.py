"""Vector features: text encoder, centred PCA, multi-label scores (ML-2 ... ML-6, TXT-12, UDF-2).

* ``embed_text``: the default encoder is a distributed ``RegexTokenizer ->
  HashingTF -> IDF -> Normalizer`` pipeline (fitted IDF is state); a user model
  plugs in through ``predict_batch_udf`` (Arrow batches of ``batch_size``
  rows on the executors).  Blank text gets the zero vector, as in the
  reference.
* ``fit_pca``: MLlib's PCA does not centre in ``transform``; we subtract the
  fitted mean first (sklearn semantics).  One vector -> first k raw values;
  none -> zeros (ML-3).
* ``fit_multilabel``: one logistic regression per label, sigmoid per label.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import vector_default, zeros
from ..session import side_by_side
from .train import held

# ---------------------------------------------------------------------------
# Fixed values from the reference configuration.
BATCH_SIZE = 32
TEXT_PCA_COMPONENTS = 45
IMAGE_PCA_COMPONENTS = 60
# ---------------------------------------------------------------------------


def fit_text_encoder(df: DataFrame, text: str = "text", dim: int = 256) -> PipelineModel:
    """Fit the default encoder (the IDF weights are its fitted state)."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="_t", outputCol="_tok", pattern=r"(?U)\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ])
    return pipe.fit(df.select(F.coalesce(F.col(text), F.lit("")).alias("_t")))


def embed_text(df: DataFrame, encoder: PipelineModel | None = None, text: str = "text", dim: int = 256,
               out: str = "embedding", make_predict_fn: Callable | None = None,
               batch_size: int = BATCH_SIZE) -> DataFrame:
    """ML-4 / JN-3: embedding per row; blank text -> zero vector."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.trim(t) == ""
    if make_predict_fn is not None:
        udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
        vec = udf(t).cast("array<double>")
        return df.withColumn(out, F.when(blank, zeros(dim)).otherwise(vec))
    if encoder is None:
        encoder = fit_text_encoder(df, text, dim)
    enc = encoder.transform(df.withColumn("_t", t))
    return (enc.withColumn(out, F.when(blank, zeros(dim)).otherwise(vector_to_array("_vec")))
            .drop("_t", "_tok", "_tf", "_idf", "_vec"))


def image_vectors(posts: DataFrame, images: DataFrame, make_predict_fn: Callable, dim: int,
                  url: str = "image_url", key: str = "post_id", out: str = "image_embedding",
                  batch_size: int = BATCH_SIZE) -> DataFrame:
    """ML-5: one vector per available image (a user model over the image bytes,
    run by ``predict_batch_udf`` on the image table, once per distinct image),
    joined to the posts by ``md5(url)``; posts without an available image get
    zeros and ``image_available = 0`` (JN-3)."""
    from .assemble import url_key
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    distinct = images.dropDuplicates(["image_key"])
    vecs = distinct.select(F.col("image_key").alias("_hit"), udf(F.col("content")).cast("array<double>").alias(out))
    return (posts.withColumn("_vk", url_key(url, key)).join(vecs, F.col("_vk") == F.col("_hit"), "left")
            .withColumn("image_available", F.col("_hit").isNotNull().cast("int"))
            .withColumn(out, F.coalesce(F.col(out), zeros(dim))).drop("_vk", "_hit"))


@dataclass
class PcaState:
    k: int
    mode: str                     # "pca", "slice" or "zeros"
    mean: list[float] | None = None
    model: object | None = None   # PCAModel

    def to_json(self) -> dict:
        return {"k": self.k, "mode": self.mode, "mean": self.mean}


def fit_pca(df: DataFrame, col: str, k: int) -> PcaState:
    """ML-2 / ML-3: centred PCA to k components (slice/zeros fallbacks).

    Mean and covariance are passes of their own: the vectors are worked out once and kept for them."""
    with held(df.select(col)) as vectors:
        return _fit_pca(vectors, col, k)


def _fit_pca(df: DataFrame, col: str, k: int) -> PcaState:
    n = df.where(F.col(col).isNotNull()).limit(2).count()
    if n == 0:
        return PcaState(k, "zeros")
    if n == 1:
        return PcaState(k, "slice")
    dim = df.select(F.size(col)).first()[0]
    vectors = df.where(F.col(col).isNotNull()).select(array_to_vector(F.col(col).cast("array<double>")).alias("_cv"))
    mean = [float(x) for x in vectors.agg(Summarizer.mean(F.col("_cv")).alias("m")).first()["m"].toArray()]
    centred = _centre(df, col, mean)
    kk = min(k, dim)
    model = PCA(k=kk, inputCol="_cv", outputCol="_pc").fit(centred)
    return PcaState(k, "pca", mean, model)


def _centre(df: DataFrame, col: str, mean: list[float]) -> DataFrame:
    mu = F.array(*[F.lit(v) for v in mean])
    arr = F.zip_with(F.col(col).cast("array<double>"), mu, lambda x, m: x - m)
    return df.withColumn("_cv", array_to_vector(arr))


def apply_pca(df: DataFrame, state: PcaState, col: str, out: str) -> DataFrame:
    if state.mode == "zeros":
        return df.withColumn(out, zeros(state.k))
    if state.mode == "slice":
        return df.withColumn(out, vector_default(col, state.k))
    res = state.model.transform(_centre(df, col, state.mean))
    return res.withColumn(out, vector_default(vector_to_array("_pc"), state.k)).drop("_cv", "_pc")


def fit_multilabel(df: DataFrame, vec: str, labels: list[str]) -> dict:
    """ML-6: one logistic regression per label on the vector column."""
    data = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))

    def fitted(lab: str):
        lr = LogisticRegression(featuresCol="_v", labelCol=lab, maxIter=50, regParam=0.01)
        return lr.fit(data.where(F.col(lab).isNotNull()).withColumn(lab, F.col(lab).cast("double")))

    return dict(zip(labels, side_by_side([partial(fitted, lab) for lab in labels])))


def sigmoid_score(vec: str, weights: list[float], intercept: float) -> Column:
    """sigmoid(w . x + b) of a vector column."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), w, lambda a, b: a * b),
                      F.lit(0.0), lambda acc, x: acc + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(float(intercept)))))


def multilabel_scores(df: DataFrame, vec: str, models: dict, prefix: str = "prob_") -> DataFrame:
    """Independent sigmoid per label."""
    return df.select("*", *[sigmoid_score(vec, m.coefficients.toArray().tolist(), m.intercept).alias(f"{prefix}{lab}")
                            for lab, m in models.items()])
