"""Text metrics: hand-made rows and a pure-Python cross-check on whole documents."""

import re

import pytest
from pyspark.sql import functions as F

from postsignal.functions import text as X

SCHEMA = "post_id long, text string, quoted_text string"


def metrics(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["post_id"]: r.asDict() for r in X.text_metrics(df).collect()}


def test_empty_and_null(spark):
    m = metrics(spark, [(1, "", None), (2, None, ""), (3, "   ", None)])
    for k in (1, 2):
        assert m[k]["text_length"] == 0 and m[k]["quoted_text_length"] == 0
        assert m[k]["combined_text_length"] == 1          # "" + " " + ""
        assert m[k]["text_word_count"] == 0 and m[k]["avg_word_length_text"] == 0.0
        assert m[k]["uppercase_ratio"] == 0.0
    assert m[3]["text_length"] == 3 and m[3]["text_word_count"] == 0


def test_hashtags_mentions_urls(spark):
    m = metrics(spark, [(1, "Bonjour #été et #fun_2 @bob_1 @élise", None),
                        (2, "see https://a.example.com/x%20y?q=1 and http://b.org", "quote #tag")])
    assert m[1]["hashtag_count"] == 2 and m[1]["mention_count"] == 2
    assert m[2]["url_count"] == 2 and m[2]["hashtag_count"] == 1
    assert m[2]["url_density"] == pytest.approx(2 / len("see https://a.example.com/x%20y?q=1 and http://b.org quote #tag"))


def test_emoji_and_non_bmp(spark):
    text = "ok \U0001F600\U0001F389 ✨ ©"
    m = metrics(spark, [(1, text, None)])
    assert m[1]["emoji_count"] == 4
    assert m[1]["text_length"] == len(text)          # code points: a non-BMP emoji counts once


def test_informal(spark):
    m = metrics(spark, [(1, "sooooo gooood!!! WOW?? aaa-bbb", None)])
    assert m[1]["word_elongation_count"] == 4        # ooooo, ooo, aaa, bbb
    assert m[1]["excessive_punctuation_count"] == 2
    c = "sooooo gooood!!! WOW?? aaa-bbb "
    assert m[1]["uppercase_ratio"] == pytest.approx(sum(ch.isupper() for ch in c) / len(c))


def _py_metrics(text, quoted):
    t, q = text or "", quoted or ""
    c = t + " " + q
    tw, qw = t.split(), q.split()
    return {
        "text_length": len(t), "combined_text_length": len(c),
        "text_word_count": len(tw), "quoted_text_word_count": len(qw),
        "avg_word_length_text": (sum(map(len, tw)) / len(tw)) if tw else 0.0,
        "mention_count": len(re.findall(r"@\w+", c)), "hashtag_count": len(re.findall(r"#\w+", c)),
        "url_count": len(re.findall(
            r'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+', c)),
        "word_elongation_count": len(re.findall(r"(\w)\1{2,}", c)),
        "excessive_punctuation_count": len(re.findall(r"[!?]{2,}", c)),
        "uppercase_ratio": sum(1 for ch in c if ch.isupper()) / len(c),
    }


def test_python_cross_check_on_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select(
        F.col("doc_id").alias("post_id"), "text", F.lit(None).cast("string").alias("quoted_text"))
    conv = spark.read.parquet(f"{sf_small}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 10_000_000).alias("post_id"), "text",
        F.lit(None).cast("string").alias("quoted_text"))
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").select(
        (F.col("page_id") + 20_000_000).alias("post_id"), F.col("html").alias("text"),
        F.col("url").alias("quoted_text"))
    df = docs.unionByName(conv).unionByName(pages)
    got = {r["post_id"]: r.asDict() for r in X.text_metrics(df).collect()}
    raw = {r["post_id"]: (r["text"], r["quoted_text"]) for r in df.collect()}
    assert len(got) == len(raw) > 0
    for k, (t, q) in raw.items():
        exp = _py_metrics(t, q)
        for name, v in exp.items():
            assert got[k][name] == pytest.approx(v, rel=1e-12, abs=1e-15), (k, name)
