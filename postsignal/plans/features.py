"""Full feature job (PIP-1): the families as one lazy plan over a post table.

Families that only need the post row are projections of one pass, without a join.  Model-based families (embeddings, PCA,
image vectors, emotion scores) attach through ``align_vectors``/joins on the
key and are added by the caller when a model is available.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import structure as S
from ..functions import text as X
from ..operators.assemble import register_family


@dataclass
class FeatureState:
    """Everything fitted for the feature job (kept in the model bundle)."""
    categories: list[str] = field(default_factory=list)


def fit_features(posts: DataFrame) -> FeatureState:
    return FeatureState(categories=S.fit_categories(posts, "tweet_type"))


def text_family(df: DataFrame, state: FeatureState | None = None) -> list:
    if X.COMBINED in df.columns:         # a lower projection has counted already
        return X.counted_metric_columns()
    return [*X.text_metric_columns(), *X.informal_metric_columns()]


def structural_family(df: DataFrame, state: FeatureState) -> list:
    return [*S.one_hot_columns("tweet_type", state.categories), *S.media_columns(),
            *S.quote_columns(), *S.temporal_columns(df)]


def attribute_family(df: DataFrame, state: FeatureState | None = None) -> list:
    if "attributes" not in df.columns:
        from pyspark.sql import functions as F
        zero = [F.lit(0.0).alias("eid")] + [F.lit(0.0).alias(n) for n in S.ATTRIBUTE_NAMES]
        return zero
    return [S.eid().alias("eid"), *S.attribute_columns()]


def emotion_family(df: DataFrame, state: FeatureState | None = None) -> list:
    from pyspark.sql import functions as F
    probs = [F.col(f"emotion_{e}") for e in S.EMOTION_LABELS]
    return [*probs, *S.emotion_summary_columns()]


FAMILIES = {"text": text_family, "structural": structural_family,
            "attributes": attribute_family, "emotional": emotion_family}

for _name, _fn in FAMILIES.items():
    register_family(_name, _fn)


def all_features(posts: DataFrame, state: FeatureState, key: str = "post_id",
                 families: list[str] | None = None, passthrough: list[str] | None = None) -> DataFrame:
    """Key + every column of the requested row-local families: one pass, the texts' counts in a projection below the others."""
    names = families or [n for n in FAMILIES if n != "emotional" or "emotion_anger" in posts.columns]
    if "text" in names:
        posts = posts.select("*", *X.count_columns())
    cols = []
    for n in names:
        cols += FAMILIES[n](posts, state)
    return posts.select(posts[key], *(passthrough or []), *cols)
