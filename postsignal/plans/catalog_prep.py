"""Driver-checked queries: full feature job, preprocessing, correlation,
importance, splits and balancing (PIP-1, PRJ-2/3, ML-1, AGG-3...6, AGG-20/21,
TOP-1/3, WIN-5...7, SET-1/2, SMP-1, BAL-1/2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structure as S
from ..operators import balance as B
from ..operators import correlation as C
from ..operators import importance as I
from ..operators import prep as P
from ..operators import split as SP
from ..registry import register
from ..sources import fixtures as FX
from ..plans.features import all_features as _all_features, fit_features
from .catalog_features import C_SQL, EMOJI_SQL, NONSPACE_SQL, Q_SQL, T_SQL, WORD_SQL, _count, _words
from ..functions import text as X

R9 = 9


# -- PIP-1 -------------------------------------------------------------------------
def _posts_full(spark, sf_dir):
    return FX.with_emotions(FX.with_attributes(FX.posts(spark, sf_dir)))


ROUNDED = ("eid", "emotional_valence", "emotional_intensity")


def _features(spark, sf_dir):
    p = _posts_full(spark, sf_dir)
    af = _all_features(p, fit_features(p))
    return af.select(*[F.round(F.col(c), R9).alias(c) if c in ROUNDED else F.col(c) for c in af.columns])


_EM_OTHERS = [n for n in S.EM_NAMES if n != S.NEUTRAL_EM]
_POS = " + ".join(f"e.emotion_{x}" for x in S.POSITIVE_EMOTIONS)
_NEG = " + ".join(f"e.emotion_{x}" for x in S.NEGATIVE_EMOTIONS)
_ALL = " + ".join(f"e.emotion_{x}" for x in S.EMOTION_LABELS)
_VIDEO = "regexp_matches(coalesce(image_url, ''), '(?i)(video|tweet_video|amplify_video|video_thumb)')"

ALL_FEATURES_SQL = f"""
SELECT p.post_id,
  length({T_SQL}) AS text_length, length({Q_SQL}) AS quoted_text_length, length({C_SQL}) AS combined_text_length,
  {_words(T_SQL)} AS text_word_count, {_words(Q_SQL)} AS quoted_text_word_count,
  {_words(T_SQL)} + {_words(Q_SQL)} AS combined_word_count,
  CASE WHEN {_words(T_SQL)} > 0 THEN {_count(T_SQL, NONSPACE_SQL)} / {_words(T_SQL)} ELSE cast(0 AS double) END
    AS avg_word_length_text,
  CASE WHEN {_words(Q_SQL)} > 0 THEN {_count(Q_SQL, NONSPACE_SQL)} / {_words(Q_SQL)} ELSE cast(0 AS double) END
    AS avg_word_length_quoted,
  {_count(C_SQL, '#' + WORD_SQL + '+')} AS hashtag_count, {_count(C_SQL, '@' + WORD_SQL + '+')} AS mention_count,
  {_count(C_SQL, X.URL_PATTERN)} AS url_count, {_count(C_SQL, EMOJI_SQL)} AS emoji_count,
  {_count(C_SQL, '#' + WORD_SQL + '+')} / length({C_SQL}) AS hashtag_density,
  {_count(C_SQL, '@' + WORD_SQL + '+')} / length({C_SQL}) AS mention_density,
  {_count(C_SQL, X.URL_PATTERN)} / length({C_SQL}) AS url_density,
  {_count(C_SQL, EMOJI_SQL)} / length({C_SQL}) AS emoji_density,
  {_count(C_SQL, r'\p{Lu}')} / length({C_SQL}) AS uppercase_ratio,
  len(list_filter(range(1, len(ch) - 1), lambda i: ch[i] = ch[i + 1] AND ch[i] = ch[i + 2]
      AND regexp_full_match(ch[i], '{WORD_SQL}') AND (i = 1 OR ch[i - 1] <> ch[i]))) AS word_elongation_count,
  {_count(C_SQL, '[!?]{2,}')} AS excessive_punctuation_count,
  cast(coalesce(tweet_type = 'QUOTE', false) AS int) AS tweet_type_QUOTE,
  cast(coalesce(tweet_type = 'REPLY', false) AS int) AS tweet_type_REPLY,
  cast(coalesce(tweet_type = 'RETWEET', false) AS int) AS tweet_type_RETWEET,
  cast(coalesce(tweet_type = 'SINGLE', false) AS int) AS tweet_type_SINGLE,
  cast(coalesce(image_url, '') <> '' AS int) AS has_image,
  cast(coalesce(image_url, '') = '' AS int) AS media_type_only_text,
  cast(coalesce(image_url, '') <> '' AND {_VIDEO} AS int) AS media_type_video,
  cast(coalesce(image_url, '') <> '' AND NOT {_VIDEO} AS int) AS media_type_image,
  cast(length({Q_SQL}) > 0 AS int) AS has_quoted_text,
  CASE WHEN length({T_SQL}) > 0 AND length({Q_SQL}) > 0 THEN length({T_SQL}) / length({Q_SQL}) END AS text_quoted_ratio,
  cast(hour(created_at) AS int) AS hour, cast(isodow(created_at) - 1 AS int) AS day_of_week,
  cast(isodow(created_at) - 1 >= 5 AS int) AS is_weekend,
  round(({' + '.join('a.' + n for n in _EM_OTHERS)} - a.EM4) * greatest({', '.join('a.' + n for n in _EM_OTHERS)})
        / sqrt(1 + {' + '.join(f'cast(a.{n} > 0.7 AS int)' for n in _EM_OTHERS)}), 9) AS eid,
  {', '.join('a.' + n for n in S.ATTRIBUTE_NAMES)},
  {', '.join('e.emotion_' + x for x in S.EMOTION_LABELS)},
  round(CASE WHEN ({_POS}) + ({_NEG}) > 0 THEN (({_POS}) - ({_NEG})) / (({_POS}) + ({_NEG}))
        ELSE cast(0 AS double) END, 9) AS emotional_valence,
  round({_ALL}, 9) AS emotional_intensity
FROM (SELECT *, string_split({C_SQL}, '') AS ch FROM posts) p
JOIN attrs a ON a.post_id = p.post_id
JOIN emo e ON e.post_id = p.post_id"""


@register("all_features", ALL_FEATURES_SQL, ids=("PIP-1", "JN-1", "UDF-1"))
def all_features(spark, sf_dir):
    return _features(spark, sf_dir)


_GROUP_VALUES = ", ".join(f"('{g}', '{p}')" for g, p in I.GROUP_PATTERNS.items())


@register("feature_groups", f"""
WITH af AS ({ALL_FEATURES_SQL}),
u AS (UNPIVOT (SELECT * EXCLUDE (post_id) FROM af) ON COLUMNS(*) INTO NAME feature VALUE v),
f AS (SELECT feature, count(*) AS non_null FROM u GROUP BY feature),
g AS (SELECT * FROM (VALUES {_GROUP_VALUES}) t("group", pattern)),
m AS (SELECT g."group", f.feature, f.non_null FROM f JOIN g ON regexp_matches(f.feature, g.pattern))
SELECT * FROM m
UNION ALL
SELECT 'other', feature, non_null FROM f WHERE feature NOT IN (SELECT feature FROM m)""", ids=("PRJ-2",))
def feature_groups(spark, sf_dir):
    af = _features(spark, sf_dir)
    cols = [c for c in af.columns if c != "post_id"]
    counts = af.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    nn = counts.selectExpr(f"stack({len(cols)}, {stack}) as (feature, non_null)")
    groups = I.feature_groups(spark, cols)
    # one row per column on each side: a schema-sized join
    return groups.join(F.broadcast(nn), "feature").select("group", "feature", "non_null")


# -- AGG-3, PRJ-3, ML-1 ----------------------------------------------------------------
NUM = FX.NUMERIC_COLUMNS


@register("null_profile", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM numeric" for c in NUM]
    + ["SELECT '__total__', " + " + ".join(f"(count(*) - count({c}))" for c in NUM) + " FROM numeric"]),
          ids=("AGG-3",))
def null_profile(spark, sf_dir):
    return P.null_profile(FX.numeric(spark, sf_dir), NUM)


@register("fill_all_null", "SELECT l_quantity, l_extendedprice, l_tax, discount_n, gross, const, "
          "coalesce(empty, cast(0 AS double)) AS empty FROM numeric", ids=("PRJ-3", "AGG-3"))
def fill_all_null(spark, sf_dir):
    return P.fill_all_null(FX.numeric(spark, sf_dir), NUM)


_SCALE_SQL = ", ".join(
    f"round((x.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1 ELSE s.s_{c} END, 6) AS {c}" for c in NUM)
_STAT_SQL = ", ".join(f"avg(coalesce({c}, 0)) AS m_{c}, stddev_pop(coalesce({c}, 0)) AS s_{c}" for c in NUM)


@register("scale_features", f"""
WITH x AS (SELECT l_quantity, l_extendedprice, l_tax, discount_n, gross, const,
                  coalesce(empty, cast(0 AS double)) AS empty FROM numeric),
s AS (SELECT {_STAT_SQL} FROM x)
SELECT {_SCALE_SQL} FROM x, s""", ids=("ML-1",))
def scale_features(spark, sf_dir):
    x = P.fill_all_null(FX.numeric(spark, sf_dir), NUM)
    st = P.fit_scaler(x, NUM)
    out = P.apply_scaler(x, st)
    return out.select(*[F.round(F.col(c), 6).alias(c) for c in NUM])


# -- AGG-4 ... AGG-6 ----------------------------------------------------------------------
def _pairs():
    return [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]


CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS corr "
    f"FROM numeric" for a, b in _pairs())


@register("pairwise_corr", f"SELECT a, b, round(corr, 9) AS corr FROM ({CORR_SQL}) c", ids=("AGG-4",))
def pairwise_corr(spark, sf_dir):
    c = C.pairwise_corr(FX.numeric(spark, sf_dir), NUM)
    return c.select("a", "b", F.round("corr", R9).alias("corr"))


_ORDER_SQL = "CASE " + " ".join(f"WHEN {{x}} = '{c}' THEN {i}" for i, c in enumerate(NUM)) + " END"


@register("correlation_drop", f"""
WITH c AS ({CORR_SQL}),
s AS (SELECT a, b, abs(corr) AS v FROM c WHERE abs(corr) > 0.8
      UNION ALL SELECT b, a, abs(corr) FROM c WHERE abs(corr) > 0.8),
d AS (SELECT DISTINCT a FROM s WHERE {_ORDER_SQL.format(x='b')} < {_ORDER_SQL.format(x='a')})
SELECT s.a AS feature, s.b AS partner, round(s.v, 9) AS abs_corr FROM s WHERE s.a IN (SELECT a FROM d)""",
          ids=("AGG-5",))
def correlation_drop(spark, sf_dir):
    num = FX.numeric(spark, sf_dir)
    out = C.correlated_columns(C.pairwise_corr(num, NUM), NUM, 0.8)
    return out.select("feature", "partner", F.round("abs_corr", R9).alias("abs_corr"))


@register("top_corr_matrix", f"""
WITH c AS ({CORR_SQL}),
f AS (SELECT a, b, abs(corr) AS v FROM c UNION ALL SELECT b, a, abs(corr) FROM c
      UNION ALL SELECT DISTINCT a, a, cast(1 AS double) FROM (SELECT a FROM c WHERE corr IS NOT NULL
                                                              UNION SELECT b FROM c WHERE corr IS NOT NULL) t),
m AS (SELECT a, avg(v) AS mv FROM f GROUP BY a HAVING avg(v) IS NOT NULL),
top AS (SELECT a FROM m ORDER BY mv DESC, {_ORDER_SQL.format(x='a')} LIMIT 4)
SELECT a, b, round(v, 9) AS abs_corr FROM f WHERE a IN (SELECT a FROM top) AND b IN (SELECT a FROM top)""",
          ids=("AGG-6",))
def top_corr_matrix(spark, sf_dir):
    num = FX.numeric(spark, sf_dir)
    out = C.top_corr_matrix(C.pairwise_corr(num, NUM), NUM, 4)
    return out.select("a", "b", F.round("abs_corr", R9).alias("abs_corr"))


# -- importance (AGG-20, AGG-21, TOP-1, TOP-3) ------------------------------------------------
@register("mean_importance", """
SELECT feature, round(sum(importance) / (SELECT count(DISTINCT label) FROM embeddings), 9) AS importance
FROM importance GROUP BY feature""", ids=("AGG-20",))
def mean_importance(spark, sf_dir):
    imp = FX.importance(spark, sf_dir)
    k = FX.table(spark, sf_dir, "embeddings").select("label").distinct().count()
    m = I.mean_importance(imp, k)
    return m.select("feature", F.round("importance", R9).alias("importance"))


@register("top_features", """
SELECT feature, importance FROM (
  SELECT feature, round(sum(importance) / (SELECT count(DISTINCT label) FROM embeddings), 9) AS importance
  FROM importance GROUP BY feature) m ORDER BY importance DESC, feature LIMIT 5""", ids=("TOP-1",))
def top_features(spark, sf_dir):
    return I.top_features(mean_importance(spark, sf_dir), 5)


TEXT_IMPORTANCE_SQL = f"""
WITH af AS ({ALL_FEATURES_SQL}),
u AS (UNPIVOT (SELECT * EXCLUDE (post_id) FROM af) ON COLUMNS(*) INTO NAME feature VALUE v),
imp AS (SELECT feature, avg(abs(v)) AS importance FROM u GROUP BY feature),
g AS (SELECT * FROM (VALUES {_GROUP_VALUES}) t("group", pattern)),
m AS (SELECT g."group", imp.feature, imp.importance FROM imp JOIN g ON regexp_matches(imp.feature, g.pattern)),
gi AS (SELECT * FROM m UNION ALL
       SELECT 'other', feature, importance FROM imp WHERE feature NOT IN (SELECT feature FROM m))"""


def _feature_importance(spark, sf_dir):
    """Importance stand-in from data: mean |value| of each feature column."""
    af = _features(spark, sf_dir)
    cols = [c for c in af.columns if c != "post_id"]
    avgs = af.agg(*[F.avg(F.abs(F.col(c).cast("double"))).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return cols, avgs.selectExpr(f"stack({len(cols)}, {stack}) as (feature, importance)")


@register("group_importance", TEXT_IMPORTANCE_SQL + """,
named AS (SELECT DISTINCT "group" FROM g UNION SELECT 'other')
SELECT n."group", count(gi.feature) AS size, round(coalesce(avg(gi.importance), 0), 6) AS mean_importance
FROM named n LEFT JOIN gi ON gi."group" = n."group" GROUP BY n."group\"""", ids=("AGG-21",))
def group_importance(spark, sf_dir):
    cols, imp = _feature_importance(spark, sf_dir)
    groups = I.feature_groups(spark, cols)
    named = spark.createDataFrame([(g,) for g in [*I.GROUP_PATTERNS, I.OTHER_GROUP]], "group string")
    gi = I.group_importance(groups, imp)
    out = named.join(gi, "group", "left").select(
        "group", F.coalesce("size", F.lit(0)).alias("size"),
        F.round(F.coalesce("mean_importance", F.lit(0.0)), 6).alias("mean_importance"))
    return out


@register("feature_budget", TEXT_IMPORTANCE_SQL + """
SELECT feature, round(importance, 6) AS importance FROM (SELECT DISTINCT feature, importance FROM gi
  WHERE "group" IN ('text_metrics', 'structural', 'temporal')) x
ORDER BY importance DESC, feature LIMIT 8""", ids=("TOP-3",))
def feature_budget(spark, sf_dir):
    cols, imp = _feature_importance(spark, sf_dir)
    groups = I.feature_groups(spark, cols)
    fb = I.feature_budget(groups, imp, ["text_metrics", "structural", "temporal"], 8)
    return fb.select("feature", F.round("importance", 6).alias("importance"))


# -- splits (WIN-5 ... WIN-7, SET-2, SMP-1) ---------------------------------------------------------
def _labelled(spark, sf_dir):
    return FX.scored(spark, sf_dir).select("event_id", "label")


@register("stratified_split", ids=("WIN-5",))
def stratified_split(spark, sf_dir):
    return SP.stratified_split(_labelled(spark, sf_dir), "label", "event_id", 0.2, 42)


@register("split_complement", """
WITH c AS (SELECT label, count(*) AS n FROM scored GROUP BY label),
q AS (SELECT label, n, n * ceil(0.2 * (SELECT count(*) FROM scored)) / (SELECT count(*) FROM scored) AS cont FROM c)
SELECT label, cast(n AS bigint) AS total, cast(n - round(cont) AS bigint) AS train, cast(round(cont) AS bigint) AS test,
       cast(0 AS bigint) AS overlap
FROM q""", ids=("SET-2", "WIN-5"))
def split_complement(spark, sf_dir):
    s = SP.stratified_split(_labelled(spark, sf_dir), "label", "event_id", 0.2, 42)
    train, test = SP.complement(s)
    tr = train.groupBy("label").agg(F.count(F.lit(1)).alias("train"))
    te = test.groupBy("label").agg(F.count(F.lit(1)).alias("test"))
    ov = train.join(test.select("event_id"), "event_id", "inner").groupBy("label").agg(F.count(F.lit(1)).alias("overlap"))
    tot = s.groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    return (tot.join(tr, "label", "left").join(te, "label", "left").join(ov, "label", "left")
            .select("label", "total", F.coalesce("train", F.lit(0)).alias("train"),
                    F.coalesce("test", F.lit(0)).alias("test"), F.coalesce("overlap", F.lit(0)).cast("long")
                    .alias("overlap")))


@register("stratified_folds", """
WITH c AS (SELECT label, count(*) AS n FROM scored GROUP BY label)
SELECT cast(f.fold AS int) AS fold, c.label, cast(c.n // 5 + CASE WHEN f.fold < c.n % 5 THEN 1 ELSE 0 END AS bigint) AS n
FROM c CROSS JOIN range(5) f(fold)""", ids=("WIN-6",))
def stratified_folds(spark, sf_dir):
    f = SP.stratified_folds(_labelled(spark, sf_dir), "label", "event_id", 5, 42)
    return f.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@register("learning_subsets", """
WITH fr AS (SELECT i, CASE WHEN i = 14 THEN cast(1 AS double)
                      ELSE i * ((cast(1 AS double) - cast(0.1 AS double)) / 14) + cast(0.1 AS double) END AS frac
            FROM range(15) t(i)),
sp AS (SELECT s.split, count(*) AS n_train FROM range(5) s(split) JOIN folds f ON f.fold <> s.split GROUP BY s.split),
sz AS (SELECT DISTINCT split, least(greatest(cast(floor(frac * n_train) AS bigint), 1), n_train) AS size FROM sp CROSS JOIN fr)
SELECT cast(split AS int) AS split, cast(row_number() OVER (PARTITION BY split ORDER BY size) - 1 AS int) AS size_idx,
       size AS n_rows FROM sz""", ids=("WIN-7",))
def learning_subsets(spark, sf_dir):
    f = FX.folds(spark, sf_dir)
    sub = SP.learning_subsets(f, "event_id", "fold", 5)
    sizes = sub.groupBy("split", "size_idx").agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window
    w = Window.partitionBy("split").orderBy("size_idx").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select(F.col("split").cast("int").alias("split"), F.col("size_idx").cast("int").alias("size_idx"),
                        F.sum("c").over(w).alias("n_rows"))


@register("seeded_sample", ids=("SMP-1",))
def seeded_sample(spark, sf_dir):
    return SP.seeded_sample(_labelled(spark, sf_dir), 100, "event_id", 42)


# -- balancing (BAL-1, BAL-2, SET-1) -------------------------------------------------------------------
@register("oversample", """
SELECT toxic AS label, max(count(*)) OVER () AS n FROM labels GROUP BY toxic""", ids=("BAL-1", "SET-1", "ML-13"))
def oversample(spark, sf_dir):
    lab = FX.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    o = B.oversample(lab, "label", "doc_id", 42)
    return o.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("undersample", """
SELECT toxic AS label, min(count(*)) OVER () AS n FROM labels GROUP BY toxic""", ids=("BAL-2", "ML-13"))
def undersample(spark, sf_dir):
    lab = FX.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    u = B.undersample(lab, "label", "doc_id", 42)
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# -- new rows between neighbours (BAL-3, BAL-4) ---------------------------------------------------------
_GROWN_SQL = """
WITH c AS (SELECT CAST(label < 2 AS INTEGER) AS y, count(*) AS n FROM embeddings GROUP BY 1),
g AS (SELECT y, n, max(n) OVER () - n AS need FROM c)
SELECT y, CAST(0 AS BIGINT) AS added, n, n AS inside FROM g
UNION ALL SELECT y, CAST(1 AS BIGINT) AS added, need AS n, need AS inside FROM g WHERE need > 0"""


def _grown(spark, sf_dir, make):
    """Counts of old and new rows by class, and of rows whose coordinates lie within the class's own range."""
    cols = [f"e{i}" for i in range(8)]
    rows = FX.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 2).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    out = make(rows, "y", "vec_id", cols)
    span = rows.groupBy(F.col("y").alias("_y")).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for c in cols:
        inside = inside & F.col(c).between(F.col(f"lo_{c}") - 1e-9, F.col(f"hi_{c}") + 1e-9)
    return (out.join(F.broadcast(span), F.col("y") == F.col("_y")).groupBy("y", F.least("copy", F.lit(1).cast("long")).alias("added"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("inside")))


@register("smote", _GROWN_SQL, ids=("BAL-3", "ML-13"))
def smote(spark, sf_dir):
    return _grown(spark, sf_dir, B.smote)


@register("adasyn", _GROWN_SQL, ids=("BAL-4", "ML-13"))
def adasyn(spark, sf_dir):
    return _grown(spark, sf_dir, B.adasyn)


# -- counts that SQL can state although the rows are chosen by hash ---------------------------
LABELS_SQL = "SELECT doc_id, toxic AS label FROM labels"


def _labels(spark, sf_dir):
    return FX.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))


@register("stratified_split_counts", f"""
WITH l AS ({LABELS_SQL}), c AS (SELECT label, count(*) AS n FROM l GROUP BY label),
t AS (SELECT sum(n) AS total, ceil(0.2 * sum(n)) AS draws FROM c),
a AS (SELECT label, n, floor(n * draws / total) AS base, n * draws / total - floor(n * draws / total) AS frac, draws FROM c, t),
q AS (SELECT label, n, base + cast(row_number() OVER (ORDER BY frac DESC, label) <= draws - sum(base) OVER () AS int) AS quota FROM a)
SELECT label, true AS is_test, cast(quota AS bigint) AS n FROM q
UNION ALL SELECT label, false, cast(n - quota AS bigint) FROM q""", ids=("WIN-5",))
def stratified_split_counts(spark, sf_dir):
    return SP.stratified_split(_labels(spark, sf_dir), "label", "doc_id", 0.2, 42).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("split_after_oversample", """
SELECT toxic AS label, max(count(*)) OVER () AS n, 0::bigint AS torn FROM labels GROUP BY toxic""", ids=("WIN-5", "WIN-6", "BAL-1"))
def split_after_oversample(spark, sf_dir):
    """Over-sampled rows split and folded: as many rows as before, all copies of a document on one side and in one fold."""
    o = B.oversample(_labels(spark, sf_dir), "label", "doc_id", 42)
    s = SP.stratified_folds(SP.stratified_split(o, "label", "doc_id", 0.2, 42), "label", "doc_id", 5, 42)
    per = s.groupBy("label", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("is_test").alias("a"), F.countDistinct("fold").alias("b"))
    return per.groupBy("label").agg(F.sum("n").alias("n"), F.sum(((F.col("a") > 1) | (F.col("b") > 1)).cast("long")).alias("torn"))


@register("sampling_ratio", """
WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic),
m AS (SELECT max(n) AS most, min(n) AS least FROM c)
SELECT 'over' AS kind, label, cast(greatest(n, floor(most * 0.5)) AS bigint) AS n FROM c, m
UNION ALL SELECT 'under', label, cast(CASE WHEN n <= least THEN n ELSE least(n, floor(least / 0.5)) END AS bigint) FROM c, m""",
          ids=("BAL-1", "BAL-2", "ML-13"))
def sampling_ratio(spark, sf_dir):
    rows = _labels(spark, sf_dir)
    over, under = B.oversample(rows, "label", "doc_id", 42, ratio=0.5).drop("copy"), B.undersample(rows, "label", "doc_id", 42, ratio=0.5)
    both = over.withColumn("kind", F.lit("over")).unionByName(under.withColumn("kind", F.lit("under")))
    return both.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


@register("seeded_sample_count", "SELECT least(count(*), 100) AS n, least(count(*), 100) AS keys FROM events", ids=("SMP-1",))
def seeded_sample_count(spark, sf_dir):
    s = SP.seeded_sample(FX.table(spark, sf_dir, "events"), 100, "event_id", 42)
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("keys"))
