import math
import random

import pytest
from pyspark.sql import functions as F

from postsignal.llm.op8_mixing import MixParams, demand, mix, mixed_documents, progress_at, training_order

SCHEMA = "doc_id long, text string, source string, size int, key string"


def _docs(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        s = rng.choice(["a"] * 6 + ["B", "b", "é", "", None])
        rows.append((k, " ".join("w" for _ in range(rng.randint(0, 30))), s, 1, "z"))
    rows += [(1000, None, "a", 1, "z"), (1001, "", "only-empty", 1, "z"), (5, "same words", "dup", 1, "z"), (5, "same words", "dup", 1, "z"),
             (None, "no id", "dup", 1, "z"), (1002, "w " * 5000, "long", 1, "z")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def _targets(rows, p=MixParams()):
    size = {}
    for _, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: p.weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, p.share * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            return size, target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over


def test_targets_and_taken_words(spark):
    rows, docs = _docs(spark)
    got = mix(docs).collect()
    size, target = _targets(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert (r["position"] is None) == (r["taken"] == 0) and all(0 <= t["position"] <= 1 for t in r["takes"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size)
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (r["id"] is None, r["id"], r["h1"], r["taken"], r["position"] or -1.0)
    assert sorted(map(key, got)) == sorted(map(key, again))
    order = [r["position"] for r in training_order(mix(docs)).collect() if r["position"] is not None]
    assert order == sorted(order)


def test_mixed_documents_are_whole_and_in_proportion(spark):
    rows, docs = _docs(spark)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    texts, got = {(r[0], r[1], r[2]) for r in rows}, out.collect()
    assert all((r["doc_id"], r["text"], r["source"]) in texts for r in got)
    size, target = _targets(rows)
    for s in ("a", "b", None):
        words = sum(len(r["text"].split()) for r in got if r["source"] == s)
        assert abs(words - target[s]) <= 30
    assert mixed_documents(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a", 1, "z"), (2, " ", None, 1, "z")], SCHEMA)
    assert [(r["taken"], r["target"]) for r in mix(nothing).collect()] == [(0, 0.0)] * 2


@pytest.mark.parametrize("k", range(3))
def test_positions_invert_the_cumulative_demand(spark, k):
    schedule = MixParams().schedules[k]
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u")).withColumn("t", progress_at(schedule, F.col("u"))).collect()
    assert all(abs(demand(schedule, r["t"]) - r["u"]) < 1e-9 for r in rows)
    assert rows[0]["t"] == 0 and abs(rows[-1]["t"] - 1) < 1e-9
