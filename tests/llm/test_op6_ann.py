import numpy as np

from postsignal.llm.op6_ann import AnnParams, Scan, rotation, search


def _brute(rows, q, k):
    vec = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i != q[0]]
    d = sorted((float(np.sqrt(((v - q[1]) ** 2).sum())), i) for i, v in vec)
    return d[:k]


def test_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(int(k), rng.standard_normal(16).astype(np.float32).tolist()) for k in range(1500)]
    hot = rng.standard_normal(16).astype(np.float32).tolist()
    good += [(2000 + k, hot) for k in range(700)]                      # a third of all rows are one vector
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [None] + [1.0] * 15), (5003, [float("nan")] + [1.0] * 15), (5004, [float("inf")] + [1.0] * 15),
           (5100, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<float>, list int, query int")
    got = {}
    for r in search(df, lambda i: i % 100 == 0, 10, params=AnnParams(shard_rows=200, query_rows=8)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    wanted = [(i, np.array(v)) for i, v in good if i % 100 == 0]
    assert set(got) == {i for i, _ in wanted}
    hit = 0
    for q in wanted:
        rows = sorted(got[q[0]])
        want = _brute(good, q, 10)
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, v) for _, s, v in rows] == sorted((s, v) for _, s, v in rows)
        hit += len({v for *_, v in rows} & {v for _, v in want})
        if q[0] >= 2000:
            assert [v for *_, v in rows] == [v for _, v in want] and rows[0][1] == 0.0
    assert hit / (10 * len(wanted)) >= 0.9


def test_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    rows = search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema), lambda i: i % 100 == 0, 10).collect()
    assert [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 2, 1.0), (2, 1, 1.414214)]
    assert search(spark.createDataFrame([], schema), lambda i: i % 100 == 0).count() == 0
    assert search(spark.createDataFrame([(0, [1.0, 0.0])], schema), lambda i: i % 100 == 0).count() == 0


def test_scan_abandons_early_and_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    x[:3000] *= 0.3
    q = x[:5] + np.float32(0.01)
    turn = rotation(64, 5)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-5)
    scan = Scan(x @ turn, q @ turn, 10, AnnParams())
    scan.run(np.arange(5), 0, 6000)
    qi, xi = scan.result()
    for k in range(5):
        want = set(np.argsort(((x - q[k]) ** 2).sum(1))[:10])
        assert len(want & set(xi[qi == k])) >= 9
    assert scan.steps < 0.8 * 5 * 6000 * 64
