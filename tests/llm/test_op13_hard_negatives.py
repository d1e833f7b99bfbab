import math
import random

import numpy as np
import pytest

from postsignal.llm.op13_hard_negatives import MineParams, mine
from postsignal.llm.rtree import RTree, Searcher, intervals


def _usable(r):
    return r[0] is not None and r[1] is not None and r[2] and len(r[2]) == 6 and all(x is not None and math.isfinite(x) for x in r[2])


def _brute(rows, is_anchor, p):
    rows = sorted({(r[0], r[1], tuple(math.floor(p.scale * x) for x in r[2])) for r in rows if _usable(r)})
    out, seen = [], set()
    for i, label, v in rows:
        if not is_anchor(i) or i in seen:
            continue
        seen.add(i)
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in ranked if x[2] == label][:p.positives]:
            fit = [x for x in ranked if x[2] != label and p.share * -s <= 100 * -x[0] <= 100 * -s][:p.negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


def _rows(seed=4):
    rng = random.Random(seed)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(k, rng.randint(0, 4), vec()) for k in range(260)]
    same = vec()
    rows += [(400 + k, 2, list(same)) for k in range(90)] + [(500 + k, 3, list(same)) for k in range(40)]          # copies: ties by id
    rows += [(600 + k, rng.randint(0, 2), [float(rng.randint(-1, 1)) for _ in range(6)]) for k in range(80)]       # many equal scores
    rows += [(700 + k, 50 + k, vec()) for k in range(20)]                                                          # labels of one row
    rows += [(10, 1, vec()), (0, 4, vec()), (20, 2, list(same)), (20, 2, list(same))]                              # repeated ids and rows
    rows += [(900, 1, None), (910, None, vec()), (None, 1, vec()), (920, 1, [math.nan] * 6), (930, 1, [math.inf] + [0.0] * 5), (940, 1, [1.0]),
             (950, 1, [None] + [0.0] * 5), (960, 2, [0.0] * 6), (970, 1, [])]
    return rows


SCHEMA = "vec_id long, label int, embedding array<double>, route int, shard string"


@pytest.mark.parametrize("p", [MineParams(), MineParams(shard_rows=40, leaf=4, fan=3, routes=3), MineParams(positives=2, negatives=9, share=30, shard_rows=100, leaf=1, fan=2)])
def test_against_all_pairs(spark, p):
    rows = _rows()
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], SCHEMA).repartition(3)
    got = mine(df, lambda i: i % 10 == 0, params=p)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _brute(rows, lambda i: i % 10 == 0, p)
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == want


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty, lambda i: i % 10 == 0).count() == 0
    one = spark.createDataFrame([(k, 1, [float(k)] * 6, 0, "") for k in range(30)], SCHEMA)
    assert mine(one, lambda i: i % 10 == 0).count() == 0                                      # one label: no negatives
    assert mine(one, lambda i: i == -1).count() == 0                                          # no anchors
    huge = spark.createDataFrame([(k, k % 2, [1e300 * (k % 3), 1.0, 0.0, 0.0, 0.0, float(k)], 0, "") for k in range(12)], SCHEMA)
    assert mine(huge, lambda i: i == 0).count() >= 0
    nulls = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    assert mine(nulls, lambda i: i == 0).count() == 0


def _tree(n=900, dim=5, labels=7, seed=1, **more):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, (n, dim)).astype(np.int32)
    label = rng.integers(0, labels, n)
    ids = [np.sort(rng.permutation(10 * n)[:rng.integers(1, 4)]) for _ in range(n)]
    return RTree(x, label, ids, **more), x, label, ids


@pytest.mark.parametrize("leaf, fan, labels", [(8, 4, 3), (1, 2, 900), (64, 16, 40), (1000, 16, 2)])
def test_boxes_hold_their_rows(leaf, fan, labels):
    t, x, label, ids = _tree(leaf=leaf, fan=fan, labels=labels)
    assert sorted(map(tuple, t.x.tolist())) == sorted(map(tuple, x.tolist())) and len(t.ids) == sum(map(len, ids))
    span = {}
    for b in range(len(t.begin)):
        if b < t.leaves:
            rows = list(range(t.begin[b], t.end[b]))
            assert 0 < len(rows) <= max(leaf, 1)
        else:
            assert 0 < t.end[b] - t.begin[b] <= fan
            rows = [r for c in range(t.begin[b], t.end[b]) for r in span[c]]
        span[b] = rows
        assert (t.low[b] == t.x[rows].min(0)).all() and (t.high[b] == t.x[rows].max(0)).all()
        assert (t.label_low[b], t.label_high[b]) == (t.label[rows].min(), t.label[rows].max())
        assert t.least[b] == min(t.ids[t.first[r]:t.first[r + 1]].min() for r in rows)
    assert span[len(t.begin) - 1] == list(range(len(t.x))) or sorted(span[len(t.begin) - 1]) == list(range(len(t.x)))
    q = np.random.default_rng(2).integers(-300, 300, (20, 5))
    least, most = intervals(q, t.low, t.high)
    for b, rows in span.items():
        s = t.x[rows].astype(np.int64) @ q.T
        assert (least[:, b] <= s.min(0)).all() and (s.max(0) <= most[:, b]).all()


def test_boxes_off_the_window_are_not_opened():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (60, 8))
    group = rng.integers(0, 60, 6000)
    x = (centres[group] + rng.integers(-30, 30, (6000, 8))).astype(np.int32)
    t = RTree(x, group % 4, [np.array([k]) for k in range(6000)], 64, 16)
    s = Searcher(t, x[:50].astype(np.int64))
    for n in range(50):
        s.positives(n, int(group[n] % 4), n, 5)
    assert s.opened < 0.25 * 50 * t.leaves
    before = s.opened
    for n in range(50):
        top = int(x[n].astype(np.int64) @ x[n])
        s.negatives(n, int(group[n] % 4), [(top * 8 // 10, top)], 5)
    assert s.opened - before < 0.5 * 50 * t.leaves


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(6)
    x = rng.integers(-(1 << 26), 1 << 26, (300, 6)).astype(np.int32)
    t = RTree(x, np.arange(300) % 2, [np.array([k]) for k in range(300)], 16, 4)
    s = Searcher(t, x[:10].astype(np.int64))
    for n in range(10):
        score = x.astype(object) @ x[n].astype(object)
        want = sorted((-int(score[j]), j) for j in range(300) if j % 2 == n % 2 and j != n)[:5]
        assert s.positives(n, n % 2, n, 5) == want
