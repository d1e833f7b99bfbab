"""JSON arrays read in splits against a whole-file parser."""

import json
import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsignal.sources.io import POST_SCHEMA, load_posts
from postsignal.sources.json_arrays import chain, read_json_arrays, record_texts, step

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("tags", T.MapType(T.StringType(), T.DoubleType()))])
PARTS = ["{", "}", "[", "]", '"', "\\", "\n", ",", "word", "é", "}}", '{"id": 7}', "\\\\", "🙂", " "]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _posts(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 30, 900])))
    return [{"id": i, "text": text() if i % 7 else None, "tags": {text()[:5] + str(k): k / 2 for k in range(rng.randrange(3))}} for i in range(n)]


def _write(root, name, value):
    with open(os.path.join(root, name), "w", encoding="utf-8") as f:
        f.write(value)


def _key(rows):
    return sorted((r["id"], r["text"], sorted((r["tags"] or {}).items())) for r in rows)


def test_one_array_over_many_splits(small_splits):
    posts = _posts(400, 1)
    root = tempfile.mkdtemp()
    _write(root, "a.json", json.dumps(posts[:150], ensure_ascii=False))                 # one line
    _write(root, "b.json", "﻿" + json.dumps(posts[150:300], indent=2))             # indented, with a mark at its start
    _write(root, "c.json", "\n".join(json.dumps(p) for p in posts[300:399]))            # lines
    _write(root, "d.json", json.dumps(posts[399]))                                      # one object
    _write(root, "e.json", "[]")
    _write(root, "f.json", "")
    lines = small_splits.read.option("lineSep", "}").text(root)
    assert lines.select("_metadata.file_block_start").distinct().count() > 50
    got = [r.asDict() for r in read_json_arrays(small_splits, root, SCHEMA).collect()]
    assert _key(got) == _key(posts)


def test_records_longer_than_splits_and_other_elements(small_splits):
    posts = [{"id": 1, "text": "{" * 5000 + '"' * 40, "tags": {}}, {"id": 2, "text": "}" * 5000, "tags": {"a": 1.0}}, {"id": 2, "text": "}" * 5000, "tags": {"a": 1.0}}]
    root = tempfile.mkdtemp()
    _write(root, "a.json", json.dumps([1, "a } { \" b" * 300, None, posts[0], [2, "}"], posts[1], "{", posts[2], "x}"]))
    assert _key(r.asDict() for r in read_json_arrays(small_splits, root, SCHEMA).collect()) == _key(posts)


def test_last_record_without_its_end(small_splits):
    root = tempfile.mkdtemp()
    _write(root, "a.json", json.dumps([{"id": i, "text": "x" * 500, "tags": {}} for i in range(5)])[:-30])
    got = read_json_arrays(small_splits, root, SCHEMA).collect()
    assert sorted(r["id"] for r in got if r["id"] is not None) == [0, 1, 2, 3] and len(got) == 5


def test_equal_to_the_whole_file_reader(small_splits):
    rng = random.Random(3)
    posts = [{"post_id": i, "text": "".join(rng.choice(PARTS) for _ in range(20)), "tweet_type": "SINGLE", "image_url": None,
              "created_at": f"2024-01-02T03:04:05.{i:06d}", "attributes": {"EM1": 0.5}, "total_trade_volume": i / 4} for i in range(200)]
    path = os.path.join(tempfile.mkdtemp(), "posts.json")
    with open(path, "w") as f:
        json.dump(posts, f)
    as_text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect())
    whole = small_splits.read.schema(POST_SCHEMA).option("multiLine", True).json(path)
    assert as_text(load_posts(small_splits, path, multiline=True)) == as_text(whole)


def test_texts_are_kept_as_written(small_splits):
    posts = _posts(60, 5)
    root = tempfile.mkdtemp()
    _write(root, "a.json", json.dumps(posts))
    assert sorted(r[0] for r in record_texts(small_splits, root).collect()) == sorted(json.dumps(p) for p in posts)


def test_step_and_chain():
    assert step('{"a": "b', False) == (True, 1)
    assert step('x{" , {"k": {', True) == (False, 2)
    assert step('a \\" {', True) == (True, 0)
    assert step('"\\\\", {', False) == (False, 1)
    sums = pd.DataFrame([("f", 0, 0, 1, 0, 1, 0, 0), ("f", 10, 0, 0, 0, 1, 0, 0), ("f", 20, 0, 0, -1, 1, 0, 0)],
                        columns=["file", "start", "inside0", "delta0", "low0", "inside1", "delta1", "low1"])
    assert chain(sums)[["inside", "depth", "began", "left"]].values.tolist() == [[0, 0, -1, 1], [0, 1, 0, 1], [0, 1, 0, 1]]
