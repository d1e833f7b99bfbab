"""Training, fold training and scoring of the booster (ML-7, ML-8, ML-9, SCR-1, TGT-2, C4).

Fits go through ``operators.boost``: the rows are binned once and all boosters of
a step (folds, calibration refits, learning-curve sizes, search trials) grow
together over that store.  Missing values need no filling: every split learns
the side they take (C4).

Fold training keeps the best round by the held-out loss with a patience of
``PATIENCE`` rounds; each fold's metrics are the exact Spark metrics of
``operators.metrics``.  Resampling and class weights touch the training part of a
fold only, never the held-out part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_checkpoint, ensure_checkpoint_dir, few_tasks, side_by_side
from . import metrics as M
from .boost import DEFAULT_PARAMS, DEFAULT_ROUNDS, Fit, Params, Store, bin_rows, fit_batch
from .trees import BoostedTrees, chosen_probability

__all__ = ["DEFAULT_PARAMS", "DEFAULT_ROUNDS", "PATIENCE", "FeatureSpec", "FoldResult", "fit_model", "fit_spec", "fold_fits", "held", "importance_table",
           "probability", "select_by_importance", "train_folds"]

# Fixed value: rounds without a better held-out loss that end a fold's fit.
PATIENCE = 50


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` cached for the block; a cache that the caller already holds is used and left alone."""
    level = df.storageLevel
    own = not (level.useMemory or level.useDisk)
    data = df.persist() if own else df
    try:
        yield data
    finally:
        if own:
            data.unpersist()


@dataclass
class FeatureSpec:
    """Fitted input layout: feature order and which columns had missing values in training."""
    columns: list[str]
    nullable: list[str] = field(default_factory=list)

    def to_json(self) -> dict:
        return {"columns": self.columns, "nullable": self.nullable}

    @classmethod
    def from_json(cls, d: dict) -> FeatureSpec:
        return cls(d["columns"], d.get("nullable", []))


def fit_spec(df: DataFrame, cols: list[str]) -> FeatureSpec:
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols]).first() if cols else {}
    return FeatureSpec(list(cols), [c for c in cols if (row[c] or 0) > 0])


def fit_model(df: DataFrame, spec: FeatureSpec, params: dict | None = None, label: str = "label",
              weight: str | None = None, key: str | None = None) -> BoostedTrees:
    """ML-7: one booster on all given rows.  ``key`` names the rows for row sampling (else equal rows are drawn together)."""
    with bin_rows(df, spec.columns, label, key, [weight] if weight else None) as store:
        return fit_batch(store, [Fit(Params.of(params), weight=weight)])[0]


def importance_table(model: BoostedTrees, spec: FeatureSpec | None = None) -> DataFrame:
    """Share of the gain per input feature."""
    # the active session is thread-local
    ss = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    own = model.importance()
    columns = spec.columns if spec else model.columns
    return ss.createDataFrame([(c, float(own.get(c, 0.0))) for c in columns], "feature string, importance double")


def probability(model: BoostedTrees, df: DataFrame, spec: FeatureSpec | None = None, out: str = "p") -> DataFrame:
    """Positive-class probability as a double column."""
    return model.probability(df, out)


@dataclass
class FoldResult:
    metrics: DataFrame            # fold, f1, precision, recall, roc_auc, pr_auc
    importance: DataFrame         # fold, feature, importance
    mean_importance: DataFrame    # feature, importance
    best_fold: int
    best_model: BoostedTrees
    models: dict[int, BoostedTrees] = field(default_factory=dict)


Resample = Callable[[DataFrame], DataFrame]
PART, OUT = "_part", "_held_out"       # of a resampled table: whose training part a row is in; whether it is held out there


def fold_numbers(df: DataFrame, fold: str, most: int = 10_000) -> list[int]:
    """The folds of a table, ascending; a column with more than ``most`` values is no fold column."""
    found = sorted(r[0] for r in df.select(fold).distinct().limit(most + 1).collect() if r[0] is not None)
    if len(found) > most:
        raise ValueError(f"{fold} has more than {most} values")
    return found


def fold_fits(folds: list[int], fold: str, params: Params, weight: str | None = None, patience: int = 0,
              columns: list[str] | None = None, among: tuple = ()) -> list[Fit]:
    """One booster per fold that learns from the other folds; its own fold decides when it stops, with ``patience``.
    ``among``: further conditions on all rows."""
    return [Fit(params, (*among, (fold, "!=", float(f))), (*among, (fold, "==", float(f))) if patience else None, columns, weight, patience) for f in folds]


@contextmanager
def _resampled(data: DataFrame, folds: list[int], fold: str, resample: Resample) -> Iterator[tuple[DataFrame, str | None]]:
    """Every fold's resampled training part and its held-out rows, one below the other, and the weight column, if any.

    A part is worked out once, by a checkpoint that ends with the block; the folds' parts side by side."""
    ensure_checkpoint_dir(data.sparkSession)
    parts = side_by_side([lambda f=f: resample(data.where(F.col(fold) != f)).checkpoint() for f in folds])
    out, weighted = None, False
    for f, part in zip(folds, parts):
        weighted = "weight" in part.columns
        check = data.where(F.col(fold) == f)
        if weighted and "weight" not in check.columns:
            check = check.withColumn("weight", F.lit(1.0))
        both = part.withColumn(OUT, F.lit(0.0)).unionByName(check.withColumn(OUT, F.lit(1.0)), allowMissingColumns=True).withColumn(PART, F.lit(float(f)))
        out = both if out is None else out.unionByName(both)
    try:
        yield few_tasks(out), "weight" if weighted else None
    finally:
        for part in parts:
            drop_checkpoint(part)


def train_folds(df: DataFrame, spec: FeatureSpec, params: dict | None = None, label: str = "label",
                fold: str = "fold", metric: str = "pr_auc", threshold: float = 0.5,
                weight: str | None = None, early_stopping: bool = True,
                resample: Resample | None = None, key: str | None = None, patience: int = PATIENCE) -> FoldResult:
    """ML-8: fit on all folds but one, score the held-out fold; the best fold's
    model (first maximum of ``metric``) is kept.  With ``early_stopping`` the
    held-out fold decides the number of rounds (as the reference's eval set).

    ``resample`` is applied to each training part (it may add a ``weight``
    column); it needs ``key`` to find its rows."""
    p, wait = Params.of(params), patience if early_stopping else 0
    keep = list(dict.fromkeys(c for c in (key, label, fold, weight, *spec.columns) if c))
    with held(df.select(*keep)) as data, ExitStack() as until:
        folds = fold_numbers(data, fold)
        if resample is None:
            rows, w, fits = data, weight, fold_fits(folds, fold, p, weight, wait)
            extra = [fold, *([w] if w else [])]
        else:
            rows, w = until.enter_context(_resampled(data, folds, fold, resample))
            w = w or weight
            extra = [PART, OUT, *([w] if w else [])]
            fits = [Fit(p, ((PART, "==", float(f)), (OUT, "==", 0.0)), ((PART, "==", float(f)), (OUT, "==", 1.0)) if wait else None, None, w, wait) for f in folds]
        with bin_rows(rows, spec.columns, label, key, extra) as store:
            models = dict(zip(folds, fit_batch(store, fits)))
        until.close()
        which = F.col(fold)
        scored = data.select(fold, label, chosen_probability([models[f] for f in folds], F.array_position(F.array(*[F.lit(f) for f in folds]), which.cast("int")).cast("int") - 1).alias("p"))
        fm = M.fold_metrics(scored, label, "p", fold, threshold)
        rows = fm.collect()                                 # one row per fold
        fm = df.sparkSession.createDataFrame(rows, fm.schema)
    table = [(f, c, v) for f in folds for c, v in {**dict.fromkeys(spec.columns, 0.0), **models[f].importance()}.items()]
    imp = df.sparkSession.createDataFrame(table, f"{fold} int, feature string, importance double")
    best = fm.orderBy(F.col(metric).desc_nulls_last(), F.col(fold).asc()).first()
    mean_imp = imp.groupBy("feature").agg((F.sum("importance") / F.lit(float(len(folds)))).alias("importance"))
    return FoldResult(fm, imp, mean_imp, best[fold], models[best[fold]], models)


def select_by_importance(df: DataFrame, spec: FeatureSpec, fold: str = "fold", k: int = 100,
                         params: dict | None = None, label: str = "label") -> list[str]:
    """ML-9: fold-averaged importance of a 100-round model, top k features."""
    p = {**(params or {}), "n_estimators": (params or {}).get("n_estimators", DEFAULT_ROUNDS)}
    res = train_folds(df, spec, p, label, fold, early_stopping=False)
    top = res.mean_importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(k).collect()
    return [r["feature"] for r in top]
