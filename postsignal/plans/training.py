"""Full training job (PIP-2) as a sequence of Spark jobs.

features -> drop invalid posts -> label -> stratified test split -> fill +
scaler + correlation pruning (fitted on the training part; ``fit_on='all'``
reproduces the reference's pre-split fit) -> folds -> balance choice ->
optional searches -> fold training -> final fit -> stage-1 evaluation ->
calibration (k refits on 70 %) -> stage-2 evaluation -> threshold sweep on the
30 % hold-out -> final evaluation -> run log + bundle.

Fitted state crosses to the driver only as O(columns) numbers and models.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.structure import binarize
from ..operators import balance as B
from ..operators import correlation as C
from ..operators import importance as I
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import split as SP
from ..operators.calibrate import calibrated_probability, fit_calibrator
from ..operators.explain import tree_attribution
from ..operators.search import choose_balance, joint_search, learning_curve, subset_search
from ..operators.train import fit_model, fit_spec, importance_table, probability, train_folds
from ..session import settled, shuffle_partitions, side_by_side
from ..sources.bundle import Bundle
from ..sources.store import metrics_rows
from .features import all_features, fit_features


@dataclass
class TrainConfig:
    threshold: float = 50.0
    seed: int = 42
    n_splits: int = 5
    test_size: float = 0.2
    calibration_holdout: float = 0.3
    optimization_metric: str = "pr_auc"
    threshold_metric: str = "f1"
    correlation_threshold: float = 0.8
    fit_on: str = "train"               # "all" = the reference's leak, for comparison
    balance_methods: tuple = ("class_weight",)
    joint_trials: int = 30              # 3 outer x 30 trials x 5 inner folds; 0 skips the search
    subset_trials: int = 50             # 0 skips the subset search
    params: dict = field(default_factory=lambda: {"n_estimators": 100})
    vectors: bool = False               # add the model-based families (encoder + PCA)
    learning_curve: bool = False        # add the learning curve to the tables
    attribution: bool = False           # add mean absolute Shapley values of the test rows to the tables
    vector_dim: int = 256
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])


@dataclass
class TrainOutput:
    bundle: Bundle
    metrics: DataFrame       # run log: run_id, stage, metric, value
    fold_metrics: DataFrame
    # class_distribution, stability, importance, lift, roc_curve, pr_curve; learning_curve and attribution if asked for
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _evaluate(scored: DataFrame, label: str, raw: str, decide_on: str, t: float) -> DataFrame:
    thr = M.binary_metrics(scored.withColumn("_d", (F.col(decide_on) > F.lit(t)).cast("int")), label, "_d")
    rank = M.ranking_metrics(scored, label, raw).select("roc_auc", "pr_auc")
    a, b = thr.first().asDict(), rank.first().asDict()
    spark = scored.sparkSession
    return spark.createDataFrame([tuple({**a, **b}.values())], list({**a, **b}.keys()))


def train_run(spark: SparkSession, posts: DataFrame, config: TrainConfig | None = None,
              invalid: DataFrame | None = None, key: str = "post_id",
              target: str = "total_trade_volume", images: DataFrame | None = None,
              make_image_model=None, emotions=None) -> TrainOutput:
    """``emotions``: a fitted ``plans.emotions.EmotionState``; its scores join the features and it goes into the bundle."""
    cfg = config or TrainConfig()
    if emotions is not None:
        from .emotions import with_emotion_scores
        posts = with_emotion_scores(posts, emotions)
    if images is not None:
        # JN-2: posts whose image URL is not in the image table are dropped
        from ..operators.assemble import with_valid_images
        posts = with_valid_images(posts, images, key=key)
    if invalid is not None:
        posts = posts.join(invalid.select(key), key, "left_anti")   # before the costly families
    posts = posts.withColumn("label", binarize(target, cfg.threshold))
    # the split comes first: everything fitted (categories, encoder, PCA, fill
    # list, scaler, pruning) sees the training part only
    posts = SP.stratified_split(posts, "label", key, cfg.test_size, cfg.seed)
    # the split's ranks bring the rows of a class to a few tasks; the families are costly, so the posts are dealt to all tasks again
    posts = posts.repartition(shuffle_partitions(spark), key)
    fit_posts = posts if cfg.fit_on == "all" else posts.where(~F.col("is_test"))
    state = fit_features(fit_posts)
    passthrough = ["label", "is_test"]
    vstate = None
    if cfg.vectors:
        from .vector_features import VECTOR_COLUMNS, fit_vector_state, with_vector_features
        vstate = fit_vector_state(fit_posts, images, make_image_model, cfg.vector_dim, key)
        posts = with_vector_features(posts, vstate, images, make_image_model, key)
        passthrough += VECTOR_COLUMNS
    split = settled(all_features(posts, state, key, passthrough=passthrough)).persist()
    cols = [c for c in split.columns if c not in (key, "label", "is_test")]
    train_raw, test_raw = SP.complement(split)
    fit_src = split if cfg.fit_on == "all" else train_raw
    fill = P.all_null_columns(fit_src, cols)
    scaler = P.fit_scaler(P.fill_all_null(fit_src, cols, fill), cols)

    def prep(df: DataFrame) -> DataFrame:
        return P.apply_scaler(P.fill_all_null(df, cols, fill), scaler)

    train, test = prep(train_raw), prep(test_raw)
    dropped = C.dropped_features(C.pairwise_corr(prep(fit_src), cols), cols, cfg.correlation_threshold)
    kept = [c for c in cols if c not in dropped]
    groups = I.group_dict(I.feature_groups(spark, kept))

    train = settled(SP.stratified_folds(train, "label", key, cfg.n_splits, cfg.seed)).persist()
    spec = fit_spec(train, kept)
    method, _ = choose_balance(spark, train, spec, key, cfg.balance_methods, "label", "fold", cfg.params, cfg.seed)
    # weights sit on all training rows; resampling happens inside training folds only
    weighted = B.balance(train, "label", key, method, cfg.seed) if method == "class_weight" else train
    weight = "weight" if "weight" in weighted.columns else None
    resample = None if method == "class_weight" else lambda part: B.balance(part, "label", key, method, cfg.seed, features=kept)

    params, selected = dict(cfg.params), kept
    if cfg.joint_trials:
        js = joint_search(spark, weighted.drop("fold"), spec, groups, "label", key,
                          trials=cfg.joint_trials, metric=cfg.optimization_metric, seed=cfg.seed, weight=weight)
        params, selected = {**params, **js.best_params}, js.best_features
    if cfg.subset_trials:
        base = train_folds(weighted, spec, params, "label", "fold", cfg.optimization_metric, weight=weight, key=key)
        imp = {r["feature"]: r["importance"] for r in base.mean_importance.collect()}
        ss = subset_search(spark, weighted, spec, groups, imp, params, "label", "fold",
                           cfg.subset_trials, cfg.seed, weight, key=key)
        selected = ss.best_features
    spec = fit_spec(weighted, selected)

    def fold_run():
        return train_folds(weighted, spec, params, "label", "fold", cfg.optimization_metric, weight=weight, resample=resample, key=key)

    def final_fit():
        return fit_model(weighted if resample is None else resample(train), spec, params, "label", weight, key)

    def calibration():
        # calibration on 70 % of the training part; its gain is measured and the
        # threshold chosen on the other 30 %
        cal_split = settled(SP.stratified_split(weighted.drop("fold", "is_test"), "label", key, cfg.calibration_holdout,
                                                cfg.seed, out="_hold"))
        calib = SP.stratified_folds(cal_split.where(~F.col("_hold")), "label", key, 5, cfg.seed)
        return cal_split, fit_calibrator(calib, spec, params, "label", "fold", "sigmoid", weight, key)

    def curve():
        return learning_curve(spark, weighted, spec, key, "label", "fold", cfg.n_splits, params=params) if cfg.learning_curve else None

    # none of these reads another's result
    folds, final, (cal_split, cal), curve_table = side_by_side([fold_run, final_fit, calibration, curve])
    scored1 = probability(final, test, spec).persist()
    stage1 = _evaluate(scored1, "label", "p", "p", 0.5)

    scored2 = calibrated_probability(scored1, cal, spec, "pc").persist()
    stage2 = _evaluate(scored2, "label", "p", "pc", 0.5)
    hold = calibrated_probability(probability(final, cal_split.where(F.col("_hold")), spec), cal, spec, "pc").persist()
    gain = M.calibration_gain(hold, "label", "p", "pc")
    best = M.best_threshold(M.threshold_sweep(hold, "label", "pc"), cfg.threshold_metric).first()
    t_best = float(best["threshold"]) if best else 0.5
    stage3 = _evaluate(scored2, "label", "p", "pc", t_best)
    classes = M.class_distribution(train)
    stability = M.fold_stability(folds.metrics)
    importance = importance_table(final, spec)

    def rows_of(table: DataFrame, name: str, values: list[str], stage: str) -> list[tuple]:
        """A short table (one row per class, metric or run) as log rows."""
        return [(stage, f"{r[name]}_{v}" if name else v, None if r[v] is None else float(r[v]))
                for r in table.collect() for v in values]
    facts = (rows_of(M.target_profile(split, "label", 0.5), "", ["n", "positive_ratio"], "dataset")
             + rows_of(classes, "class", ["count", "proportion"], "classes")
             + rows_of(stability, "metric", ["mean", "std", "cv"], "stability")
             + [("threshold", "chosen", t_best), ("features", "kept", float(len(kept))), ("features", "selected", float(len(selected)))]
             + [("parameters", k, float(v)) for k, v in sorted(params.items()) if isinstance(v, (int, float))])
    run = cfg.run_id
    log = (metrics_rows(stage1, run, "stage1").unionByName(metrics_rows(stage2, run, "stage2"))
           .unionByName(metrics_rows(gain, run, "calibration"))
           .unionByName(metrics_rows(stage3, run, "final"))
           .unionByName(spark.createDataFrame([(run, *f) for f in facts], "run_id string, stage string, metric string, value double")))
    bundle = Bundle(model=final, spec=spec, threshold=t_best, selected=selected, groups=groups,
                    metrics={r["stage"] + "_" + r["metric"]: r["value"] for r in log.collect()},
                    scaler=scaler, fill_list=fill, categories=state.categories,
                    importance=importance, calibrator=cal,
                    optimization_metric=cfg.optimization_metric, threshold_metric=cfg.threshold_metric,
                    extra={"dropped": dropped, "balance_method": method, "params": params},
                    vectors=vstate, emotions=emotions)
    tables = {"class_distribution": classes, "stability": stability, "importance": I.top_features(importance, 30),
              "lift": M.lift_table(scored2.select(key, "label", "pc"), "label", "pc", key),
              "roc_curve": M.roc_curve(scored2, "label", "p"), "pr_curve": M.pr_curve(scored2, "label", "p")}
    if cfg.learning_curve:
        tables["learning_curve"] = curve_table
    if cfg.attribution:
        tables["attribution"] = I.attribution_rank(tree_attribution(test, final, key), 20)
    tables = dict(zip(tables, side_by_side([v.checkpoint for v in tables.values()])))
    log = log.checkpoint()
    for held in (scored1, scored2, hold, train, split):
        held.unpersist()
    return TrainOutput(bundle, log, folds.metrics, tables)
