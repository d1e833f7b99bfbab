import re

import pytest

import corpus_pipeline
from postsignal.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{base}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages_keep_their_promises(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "packing"]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{tables}/labels.parquet").filter("toxic = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == columns
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(before[r["doc_id"]] == r["text"] for r in after.collect())
        if name == "toxicity":
            gone = set(before) - {r["doc_id"] for r in after.collect()}
            assert len(gone & toxic) > 0.5 * len(toxic) and len(gone - toxic) < 0.2 * len(before)
        if name == "near_dedup":
            kept = [r["doc_id"] for r in after.collect()]
            assert len(kept) == len(set(kept))
        docs = after
    taken = spark.read.parquet(str(tmp_path / "mixing")).count()
    assert docs.filter("piece = 0").count() == taken


def test_all_operators_are_registered():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_odd_rows_and_clashing_columns(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    some = docs.limit(40).collect()
    odd = [(100_000, None, None, None, 0), (100_001, "", "en", "x", 0), (100_002, " \t", "en", "x", 2), (100_003, "word " * 60_000, "en", "long", 300_000),
           (100_004, "same short text here now", "en", "x", 24), (100_005, "same short text here now", "en", "y", 24), (100_004, "same short text here now", "en", "x", 24),
           (None, "a text without an id of its own", "en", "x", 31), (100_006, "é" * 5000, "fr", None, 5000)]
    rows = [tuple(r[c] for c in docs.columns) for r in some] + [tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), o))[c] for c in docs.columns) for o in odd]
    extra = ["id", "score", "predicted", "size", "h", "label", "component_id", "kept", "position", "takes"]
    data = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], docs.schema.simpleString()[7:-1].replace(":", " ") + ", " + ", ".join(f"{c} int" for c in extra)).repartition(3)
    now = data
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, tables)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            ids = {r["doc_id"] for r in after.collect()}
            assert ids == {r["doc_id"] for r in now.collect()}
            break
        assert after.columns == data.columns
        got = after.collect()
        assert all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in got)
        before = {(r["doc_id"], r["text"]) for r in now.collect()}
        assert {(r["doc_id"], r["text"]) for r in got} <= before
        ids = [r["doc_id"] for r in got]
        if name == "near_dedup":
            assert {100_000, 100_001, 100_002, 100_003, 100_006, None} & set(r["doc_id"] for r in now.collect()) <= set(ids)
            assert 100_004 in ids and 100_005 not in ids
        now = after
