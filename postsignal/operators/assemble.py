"""Family assembly and key joins (JN-1 ... JN-4, PRJ-1, UDF-1).

Families computed from the same post table are one projection (no join);
families that come from elsewhere (image table, feature store, model output)
are joined on the key.  Joins are left joins on a unique key, so the row count
of the post table is preserved; Spark's planner (with AQE runtime sizes)
chooses the strategy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import image_key

Family = Callable[[DataFrame], DataFrame]
_FAMILIES: dict[str, Family] = {}
SALTS = 1024               # partitions' worth of posts without an image URL


def register_family(name: str, fn: Family) -> None:
    """UDF-1: a feature family is ``DataFrame -> DataFrame`` keeping the key."""
    _FAMILIES[name] = fn


def has_url(url: str = "image_url") -> Column:
    return F.coalesce(F.col(url), F.lit("")) != ""


def url_key(url: str = "image_url", key: str = "post_id") -> Column:
    """Join key of a post's image; posts without a URL get one of ``SALTS``
    values that match nothing, so that they do not meet in one partition."""
    salt = F.concat(F.lit("-"), F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("string"))
    return F.when(has_url(url), image_key(url)).otherwise(salt)


def join_families(key: str, frames: list[DataFrame]) -> DataFrame:
    """JN-1: align family tables on ``key`` (left joins from the first)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on=key, how="left")
    return out


def join_on_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN-4: actual with predicted, by key."""
    return left.join(right, on=key, how="inner")


def image_availability(posts: DataFrame, images: DataFrame, url: str = "image_url",
                       key: str = "post_id", keep_missing: bool = False) -> DataFrame:
    """ML-5 flag: 1 when the post's image is in the image table.

    Posts without an image URL are dropped unless ``keep_missing``; the image
    table is reduced to distinct keys before the one left join (adaptive
    execution splits the posts of a widely shared image).
    """
    keys = images.select(F.col("image_key").alias("_hit")).distinct()
    joined = (posts.withColumn("_k", url_key(url, key)).join(keys, F.col("_k") == F.col("_hit"), "left")
              .withColumn("image_available", F.col("_hit").isNotNull().cast("int")).drop("_k", "_hit"))
    return joined if keep_missing else joined.where(has_url(url))


def with_valid_images(posts: DataFrame, images: DataFrame, url: str = "image_url", key: str = "post_id") -> DataFrame:
    """JN-2 in one pass: ``posts`` without those whose image is not in the image table."""
    flagged = image_availability(posts, images, url, key, keep_missing=True)
    return flagged.where((F.col("image_available") == 1) | ~has_url(url)).drop("image_available")


def drop_invalid(df: DataFrame, invalid: DataFrame, key: str = "post_id") -> DataFrame:
    """JN-2: remove posts listed as invalid (anti join on the key)."""
    return df.join(invalid.select(key), on=key, how="left_anti")


def select_features(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    """PRJ-1: keep the selected features; when one is missing keep all."""
    have = set(df.columns)
    if not all(c in have for c in cols):
        return df
    keep = ([key] if key else []) + [c for c in cols if c != key]
    return df.select(*keep)
