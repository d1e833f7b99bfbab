import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import postsignal.llm.op9_fingerprints as op9

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, fp int, `_bucket` int"


def _set(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t)]
    return ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set()


def _rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé😀") for _ in range(rng.randint(1, 5)))
    rows = [(k * k * 7 - 500, " ".join(word() for _ in range(rng.randint(0, 300)))) for k in range(200)]
    rows += [(90_000, None), (90_001, ""), (90_002, "a"), (90_003, "A"), (90_004, "one two"), (90_005, "a z"), (90_005, "b c d"), (None, "no id at all"), (10**17, "far away")]
    return rows


@pytest.mark.parametrize("bucket_rows,scale", [(3, 1), (512, 4)])
def test_edited_texts_and_likeness(spark, monkeypatch, bucket_rows, scale):
    monkeypatch.setattr(op9, "BUCKET_ROWS", bucket_rows)
    rows = _rows()
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(4)
    got = op9.edited_fingerprints(df, scale=scale).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = sorted(got, key=lambda r: (r["id"] is not None, r["id"] or 0, r["n_chars"]))
    assert len(got) == len(rows)
    for k, ((i, t), r) in enumerate(zip(ordered, got)):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert r["id"] == i and r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = _set(t), _set(edited), _set(nxt)
        assert (len(r["fp"]) > 0) == (len(a) > 0) and r["fp"] == sorted(r["fp"])
        if scale == 1:
            like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
            assert len(r["fp"]) == len(a) and abs(r["near_edited"] - like(a, b)) < 1e-9 and abs(r["near_next"] - like(a, c)) < 1e-9


def test_small_tables_and_functions(spark):
    assert op9.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = op9.edited_fingerprints(spark.createDataFrame([(1, "abcd", 1, 1)], SCHEMA)).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    t = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    fp = lambda c: op9.fingerprint(F.col(c), 4)
    df = spark.createDataFrame([(t(0, 2000), t(0, 400), t(2000, 4000), t(0, 4000))], "a string, b string, c string, d string")
    r = df.select(op9.containment(fp("b"), fp("a")).alias("inside"), op9.containment(fp("a"), fp("b")).alias("outside"),
                  op9.likeness(op9.merge(fp("a"), fp("c")), fp("d")).alias("merged"), op9.fingerprint_text(fp("a")).alias("s")).first()
    assert r["inside"] == 1.0 and abs(r["outside"] - 0.2) < 0.06 and r["merged"] > 0.98
    assert len(r["s"]) % 16 == 0 and 400 < len(r["s"]) / 16 < 600


@pytest.mark.parametrize("ids", [
    [*range(1999), None],                                  # the null id shares no segment with others
    [*range(1000), None, None, -(1 << 63), -(1 << 63) + 1, (1 << 63) - 1],
    [-(1 << 63), (1 << 63) - 1, None, 0],
    [None, None],
])
def test_null_and_extreme_ids_at_the_production_bucket_size(spark, ids):
    rows = [(i, f"{k:05d} text") for k, i in enumerate(ids)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for k, (i, t) in enumerate(ordered):
        half = len(t) // 2
        expected.append((i, hashlib.sha256((t[:len(t) - half] + ordered[(k + 1) % len(ordered)][1][:half]).encode()).hexdigest()))
    got = [(r["id"], r["edited_sha256"]) for r in op9.edited_fingerprints(df).select("id", "edited_sha256").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
