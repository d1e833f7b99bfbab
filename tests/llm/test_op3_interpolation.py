import math
import re
import zlib
from collections import Counter

import numpy as np

from postsignal.llm.op3_interpolation import LmParams, context_bucket, learn_weights, mixture, pack, score_documents, unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, dtype=np.uint64), np.array([0, 1, 255, 256, 2**64 - 1], dtype=np.uint64), rng.integers(0, 2**40, 1000).astype(np.uint64)):
        assert (unpack(pack(x)) == x).all()


def _tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + [None]


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = ["The", "cat", "sat", "on", "mat", "dog", "É", "x y"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12), p=[.3, .2, .1, .1, .1, .1, .05, .05])) for _ in range(300)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(1000, None, 1), (1001, "", 1), (None, "the cat", 1), (4, texts[4], 1), (1002, "zebra " * 300, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train int")
    p = LmParams(order=3, block_bytes=2000, range_tokens=200)
    got = score_documents(docs, lambda crc: crc % 5 != 1, params=p).collect()
    assert len(got) == len(rows)
    train = [t for i, t, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        x = ["^", *_tokens(t)]
        c1.update(x[1:])
        c2.update(zip(x, x[1:]))
        c3.update(zip(x, x[1:], x[2:]))
    n, v = sum(c1.values()), len(c1)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, _ in rows:
        x = _tokens(t)
        r = by[i][0]
        assert r["train_tokens"] == n and r["n_tokens"] == len(x) and r["n_known"] == sum(c1[w] > 0 for w in x)
        assert math.isclose(r["base_score"], sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # the mixture itself: total counts reach the tokens, and probabilities of all next words add up to one
    weights = np.random.default_rng(2).dirichlet(np.ones(4), 64)
    x = ["^", *_tokens(texts[0])]
    counts = [np.array([c1[w] for w in x[1:]]), np.array([c2[a] for a in zip(x, x[1:])]), np.array([0, *[c3[a] for a in zip(x, x[1:], x[2:])]])]
    prob = mixture(counts, np.array([0, len(x) - 1]), weights, n, v)
    k = 2
    ctx1, ctx2 = c1[x[k]], c2[(x[k - 1], x[k])]
    w = weights[context_bucket([np.array([ctx1]), np.array([ctx2])])[0]]
    f = lambda word: w[0] / (v + 1) + w[1] * c1[word] / n + w[2] * c2[(x[k], word)] / max(ctx1, 1) + w[3] * c3[(x[k - 1], x[k], word)] / max(ctx2, 1)
    assert math.isclose(prob[k], f(x[k + 1]))
    if ctx2:
        assert math.isclose(sum(f(word) for word in c1) + w[0] / (v + 1), 1.0)


def test_learning_raises_likelihood_and_empty_cases(spark):
    cell = np.array([0, 0, 40 * 32**3 + 5]).astype(np.int64)
    sums = np.array([[50.0, 0.0, 0.0], [100.0, 0.0, 0.0], [10.0, 5.0, 8.0]])
    n = np.array([10.0, 10.0, 10.0])
    w = learn_weights(cell, n, sums, 1000.0, 100, 3, 50)
    assert np.allclose(w.sum(axis=1), 1) and w[40, 3] > w[40, 1]
    schema = "doc_id long, text string"
    assert score_documents(spark.createDataFrame([], schema), lambda c: c % 5 != 1).count() == 0
    one = score_documents(spark.createDataFrame([(1, "a b")], schema), lambda c: c < 0).collect()[0]     # nothing to learn from
    assert one["train_tokens"] == 0 and one["n_known"] == 0 and math.isclose(one["score"], 0.0, abs_tol=1e-6)
