"""Fixture views over the driver tables (FIXTURES.md).

Each view exists twice: as a Spark DataFrame plan (what the library runs)
and as DuckDB SQL text (what the independent oracle runs).  Both read the
same parquet tables, so every registered query's work grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.structure import ATTRIBUTE_NAMES, EMOTION_LABELS
from ..session import shuffle_partitions

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# ---------------------------------------------------------------------------
# Fixed values of the fixture definitions (FIXTURES.md).
TYPE_OF_EVENT = {"click": "SINGLE", "view": "REPLY", "signup": "QUOTE", "purchase": "RETWEET"}
QUOTE_EVERY = 3          # post p quotes document p - 1 when p % 3 = 0
MISSING_MAP_EVERY = 10   # attribute map is NULL when p % 10 = 9
BLANK_EMO_EVERY = 25     # all emotion probabilities 0 when p % 25 = 0
SCORE_TARGET = 50.0
NO_IMAGE_EVERY, NO_IMAGE_AT = 16, 5   # page p has no stored image when p % 16 = 5
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post table with input schema S, derived from documents/events/pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), "event_type", "ts", "value")
    q = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("q_text"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    mapping = F.create_map(*[F.lit(x) for kv in TYPE_OF_EVENT.items() for x in kv])
    joined = (d.join(e, "doc_id").join(q, "doc_id", "left").join(p, "doc_id", "left")
              .select(F.col("doc_id").alias("post_id"), "text",
                      F.when(F.col("doc_id") % QUOTE_EVERY == 0, F.col("q_text")).alias("quoted_text"),
                      mapping[F.col("event_type")].alias("tweet_type"),
                      F.col("url").alias("image_url"),
                      F.col("ts").alias("created_at"),
                      F.col("value").alias("total_trade_volume")))
    # A post table is hash-partitioned by its key.  At scale the sort-merge
    # joins above already are (the exchange is then elided); with the small
    # driver tables the joins are broadcast and the whole table would sit in
    # the single split of a one-row-group file, so the regex families would
    # run in one task.
    return joined.repartition(shuffle_partitions(spark), "post_id")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image store: one object per page; a sixteenth of the pages has none."""
    from .io import image_table_from_pages
    pages = table(spark, sf_dir, "pages")
    return image_table_from_pages(pages.where(F.col("page_id") % NO_IMAGE_EVERY != NO_IMAGE_AT))


def attribute_value_expr(key, i: int):
    return ((key * 7 + i * 13) % 100).cast("double") / F.lit(100.0)


def with_attributes(df: DataFrame, key: str = "post_id") -> DataFrame:
    k = F.col(key)
    kv = []
    for i, name in enumerate(ATTRIBUTE_NAMES, start=1):
        kv += [F.lit(name), attribute_value_expr(k, i)]
    return df.withColumn("attributes", F.when(k % MISSING_MAP_EVERY != 9, F.create_map(*kv)))


def with_emotions(df: DataFrame, key: str = "post_id") -> DataFrame:
    k = F.col(key)
    cols = []
    for i, label in enumerate(EMOTION_LABELS, start=1):
        v = ((k * 11 + i * 17) % 100).cast("double") / F.lit(100.0)
        cols.append(F.when(k % BLANK_EMO_EVERY == 0, F.lit(0.0)).otherwise(v).alias(f"emotion_{label}"))
    return df.select("*", *cols)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, label, score) from events; integer-built score, many ties."""
    ev = table(spark, sf_dir, "events")
    score_k = (F.floor(F.least(F.col("value"), F.lit(100.0)) * F.lit(70.0)).cast("long")
               + ((F.col("event_id") * 7919) % 1000) * 3)
    return ev.select("event_id", (F.col("value") >= SCORE_TARGET).cast("int").alias("label"),
                     (score_k.cast("double") / F.lit(10000.0)).alias("score"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("fold", (F.col("event_id") % 5).cast("int"))


NUMERIC_COLUMNS = ["l_quantity", "l_extendedprice", "l_tax", "discount_n", "gross", "const", "empty"]


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_tax",
                     F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("discount_n"),
                     (F.col("l_extendedprice") * (F.lit(1.0) + F.col("l_tax"))).alias("gross"),
                     F.lit(1.0).alias("const"),
                     F.lit(None).cast("double").alias("empty"))


def importance(spark: SparkSession, sf_dir: str, dims: int = 8) -> DataFrame:
    """(fold, feature, importance): label of ``embeddings`` as fold."""
    emb = table(spark, sf_dir, "embeddings")
    aggs = [F.avg(F.abs(F.col("embedding")[i].cast("double"))).alias(f"d{i}") for i in range(dims)]
    wide = emb.groupBy(F.col("label").alias("fold")).agg(*aggs)
    stack = "stack({n}, {args}) as (feature, importance)".format(
        n=dims, args=", ".join(f"'d{i}', d{i}" for i in range(dims)))
    return wide.selectExpr("fold", stack)


# ---------------------------------------------------------------------------
# DuckDB text of the same views, for the oracle side.
_ATTR_SQL = ", ".join(
    f"CASE WHEN post_id % 10 = 9 THEN cast(0 AS double) ELSE "
    f"cast((post_id * 7 + {i} * 13) % 100 AS double) / cast(100 AS double) END AS {n}"
    for i, n in enumerate(ATTRIBUTE_NAMES, start=1))
_EMO_SQL = ", ".join(
    f"CASE WHEN post_id % 25 = 0 THEN cast(0 AS double) ELSE "
    f"cast((post_id * 11 + {i} * 17) % 100 AS double) / cast(100 AS double) END AS emotion_{lab}"
    for i, lab in enumerate(EMOTION_LABELS, start=1))

VIEW_SQL = {
    "posts": """
SELECT d.doc_id AS post_id, d.text,
       CASE WHEN d.doc_id % 3 = 0 THEN q.text END AS quoted_text,
       CASE e.event_type WHEN 'click' THEN 'SINGLE' WHEN 'view' THEN 'REPLY'
                         WHEN 'signup' THEN 'QUOTE' WHEN 'purchase' THEN 'RETWEET' END AS tweet_type,
       p.url AS image_url, e.ts AS created_at, e.value AS total_trade_volume
FROM documents d
JOIN events e ON e.event_id = d.doc_id
LEFT JOIN documents q ON q.doc_id = d.doc_id - 1
LEFT JOIN pages p ON p.page_id = d.doc_id""",
    "image_keys": """
SELECT DISTINCT md5(url) AS k FROM pages WHERE page_id % 16 <> 5 AND octet_length(encode(html)) > 0""",
    "attrs": f"SELECT post_id, {_ATTR_SQL} FROM posts",
    "emo": f"SELECT post_id, {_EMO_SQL} FROM posts",
    "scored": """
SELECT event_id, label, cast(score_k AS double) / cast(10000 AS double) AS score
FROM (SELECT event_id, cast(value >= 50 AS int) AS label,
             cast(floor(least(value, cast(100 AS double)) * cast(70 AS double)) AS bigint)
             + ((event_id * 7919) % 1000) * 3 AS score_k
      FROM events) s""",
    "folds": "SELECT *, cast(event_id % 5 AS int) AS fold FROM scored",
    "numeric": """
SELECT l_quantity, l_extendedprice, l_tax,
       CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS discount_n,
       l_extendedprice * (cast(1 AS double) + l_tax) AS gross,
       cast(1 AS double) AS const, cast(NULL AS double) AS empty
FROM lineitem""",
    "importance": "SELECT label AS fold, 'd' || cast(i AS varchar) AS feature, "
                  "avg(abs(cast(embedding[i + 1] AS double))) AS importance "
                  "FROM embeddings, range(8) t(i) GROUP BY label, i",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the fixture views it uses (transitively)."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I):
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    body = sql.lstrip()
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"
