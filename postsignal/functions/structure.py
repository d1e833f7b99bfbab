"""Structural, temporal, attribute and emotion columns (STR-*, ATT-*, EMO-*).

All are single-row projections on built-in expressions.  The only fitted
piece is the post-type category list (STR-1), fetched once as a distinct
aggregate; it is part of the model state, one column per category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import VIDEO_PATTERN, text_or_empty

# ---------------------------------------------------------------------------
# Attribute names, emotion labels and their valence split.
EM_NAMES = [f"EM{i}" for i in range(1, 12)]
SS_NAMES = [f"SS{i}" for i in range(1, 8)]
CT_NAMES = [f"CT{i}" for i in range(1, 9)]
ATTRIBUTE_NAMES = EM_NAMES + SS_NAMES + CT_NAMES
NEUTRAL_EM = "EM4"
SIGNIFICANT_LEVEL = 0.7
EMOTION_LABELS = ["anger", "anticipation", "disgust", "fear", "joy", "love",
                  "optimism", "pessimism", "sadness", "surprise", "trust"]
POSITIVE_EMOTIONS = ["joy", "love", "optimism", "trust", "anticipation", "surprise"]
NEGATIVE_EMOTIONS = ["anger", "disgust", "fear", "pessimism", "sadness"]
POST_TYPES = ["SINGLE", "REPLY", "QUOTE", "RETWEET"]
# ---------------------------------------------------------------------------

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- STR-1 ---------------------------------------------------------------
def fit_categories(df: DataFrame, col: str = "tweet_type") -> list[str]:
    """Sorted distinct non-null values (the fitted one-hot vocabulary).

    The list is model state: one output column per value, saved in the bundle."""
    vals = df.where(F.col(col).isNotNull()).select(col).distinct().collect()
    return sorted(r[0] for r in vals)


def one_hot_columns(col: str, categories: list[str], prefix: str | None = None) -> list[Column]:
    prefix = prefix or col
    return [F.coalesce((F.col(col) == F.lit(v)), F.lit(False)).cast("int").alias(f"{prefix}_{v}")
            for v in categories]


# -- STR-2 / STR-3 -------------------------------------------------------
def has_image(url="image_url") -> Column:
    return (text_or_empty(url) != F.lit("")).cast("int")


def media_columns(url="image_url") -> list[Column]:
    u = text_or_empty(url)
    present = u != F.lit("")
    video = u.rlike(VIDEO_PATTERN)
    return [
        present.cast("int").alias("has_image"),
        (~present).cast("int").alias("media_type_only_text"),
        (present & video).cast("int").alias("media_type_video"),
        (present & ~video).cast("int").alias("media_type_image"),
    ]


# -- STR-4 / STR-5 -------------------------------------------------------
def quote_columns(text="text", quoted="quoted_text") -> list[Column]:
    tl = F.length(text_or_empty(text))
    ql = F.length(text_or_empty(quoted))
    return [
        (ql > 0).cast("int").alias("has_quoted_text"),
        F.when((tl > 0) & (ql > 0), tl / ql).alias("text_quoted_ratio"),
    ]


# -- STR-7 ---------------------------------------------------------------
def as_timestamp(c, dtype: T.DataType) -> Column:
    """String dates are parsed first; timestamps pass through."""
    if isinstance(dtype, T.StringType):
        return F.to_timestamp(_c(c))
    return _c(c)


def temporal_columns(df: DataFrame, ts: str = "created_at") -> list[Column]:
    t = as_timestamp(ts, df.schema[ts].dataType)
    dow = F.weekday(t)  # Monday = 0
    return [
        F.hour(t).cast("int").alias("hour"),
        dow.cast("int").alias("day_of_week"),
        (dow >= 5).cast("int").alias("is_weekend"),
    ]


# -- ATT-1 / ATT-2 -------------------------------------------------------
def attribute_value(name: str, col: str = "attributes") -> Column:
    """Map lookup, missing key or missing map -> 0.0."""
    return F.coalesce(F.col(col).getItem(name).cast("double"), F.lit(0.0))


def attribute_columns(col: str = "attributes") -> list[Column]:
    return [attribute_value(n, col).alias(n) for n in ATTRIBUTE_NAMES]


def eid(col: str = "attributes") -> Column:
    """Emotional intensity index from the EM attributes."""
    others = [attribute_value(n, col) for n in EM_NAMES if n != NEUTRAL_EM]
    neutral = attribute_value(NEUTRAL_EM, col)
    total = others[0]
    for o in others[1:]:
        total = total + o
    strongest = F.greatest(*others)
    flags = [(o > SIGNIFICANT_LEVEL).cast("int") for o in others]
    significant = flags[0]
    for f in flags[1:]:
        significant = significant + f
    return (total - neutral) * strongest / F.sqrt(F.lit(1.0) + significant)


# -- EMO-1 / EMO-2 -------------------------------------------------------
def emotion_summary_columns(prefix: str = "emotion_") -> list[Column]:
    pos = [F.col(prefix + e) for e in POSITIVE_EMOTIONS]
    neg = [F.col(prefix + e) for e in NEGATIVE_EMOTIONS]
    p = pos[0]
    for c in pos[1:]:
        p = p + c
    n = neg[0]
    for c in neg[1:]:
        n = n + c
    allp = [F.col(prefix + e) for e in EMOTION_LABELS]
    s = allp[0]
    for c in allp[1:]:
        s = s + c
    total = p + n
    return [
        F.when(total > 0, (p - n) / total).otherwise(F.lit(0.0)).alias("emotional_valence"),
        s.alias("emotional_intensity"),
    ]


# -- TGT-1 / TGT-2 -------------------------------------------------------
def binarize(c, threshold: float = 50.0) -> Column:
    """label = (y >= threshold)."""
    return (_c(c) >= F.lit(float(threshold))).cast("int")


def apply_threshold(p, threshold: float = 0.5) -> Column:
    """decision = (p > threshold), strict."""
    return (_c(p) > F.lit(float(threshold))).cast("int")


def structure(df: DataFrame, categories: list[str], key: str = "post_id") -> DataFrame:
    """Structural family without the vector-based diversity columns."""
    return df.select(F.col(key), *one_hot_columns("tweet_type", categories),
                     *media_columns(), *quote_columns(), *temporal_columns(df))
