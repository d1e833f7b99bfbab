"""Leaf-wise booster (ML-7, ML-8): against a plain row-by-row booster, patience, batches, storage."""

import math
import random

import numpy as np
import pytest

from postsignal.operators import boost
from postsignal.operators.boost import UNIT, Fit, Params, bin_rows, fit_batch
from postsignal.operators.trees import BoostedTrees

COLS = ["a", "b", "c", "d"]


def _rows(n=500, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.gauss(0, 1), rng.randint(0, 5), rng.choice([None, 0.0, 1.0, 2.5])
        d = rng.random() if rng.random() < 0.8 else None
        y = int(a + 0.4 * b - (1.0 if c is None else 0.0) + (1.5 if d is None else 0.0) + rng.gauss(0, 0.7) > 1)
        rows.append((k, y, a, float(b), c, d, rng.choice([1.0, 2.0])))
    return rows


SCHEMA = "id long, label int, a double, b double, c double, d double, w double"


class Plain:
    """The same objective, one row and one threshold at a time."""

    def __init__(self, rows, p, weights=None):
        self.p, self.x = p, [[math.nan if v is None else v for v in r[2:6]] for r in rows]
        self.y = [r[1] for r in rows]
        self.w = weights or [1.0] * len(rows)
        self.values = [sorted({x[f] for x in self.x if not math.isnan(x[f])}) for f in range(4)]
        rate = sum(w * y for w, y in zip(self.w, self.y)) / sum(self.w)
        self.margin = [math.log(rate / (1 - rate))] * len(rows)
        for _ in range(p.rounds):
            self.round()

    def sums(self, rows):
        return sum(self.g[i] for i in rows), sum(self.h[i] for i in rows)

    def score(self, rows):
        g, h = self.sums(rows)
        g, h = g / UNIT, h / UNIT
        return max(abs(g) - self.p.l1, 0.0) ** 2 / (h + self.p.l2)

    def best(self, rows):
        found = None
        for f in range(4):
            gone = [i for i in rows if math.isnan(self.x[i][f])]
            there = [i for i in rows if not math.isnan(self.x[i][f])]
            for v in self.values[f]:
                for side in ((0, 1) if gone else (0,)):
                    left = [i for i in there if self.x[i][f] <= v] + (gone if side else [])
                    right = [i for i in there if self.x[i][f] > v] + ([] if side else gone)
                    if min(len(left), len(right)) < max(1, self.p.least_rows) or min(self.sums(left)[1], self.sums(right)[1]) < 1e-3 * UNIT:
                        continue
                    gain = self.score(left) + self.score(right) - self.score(rows)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, left, right)
        return found

    def round(self):
        p = [1 / (1 + math.exp(-m)) for m in self.margin]
        self.g = [round((a - y) * w * UNIT) for a, y, w in zip(p, self.y, self.w)]
        self.h = [round(a * (1 - a) * w * UNIT) for a, w in zip(p, self.w)]
        leaves = [(list(range(len(self.x))), 0)]
        splits = {0: self.best(leaves[0][0])}
        while len(leaves) < self.p.leaves:
            able = [(s[0], -k) for k, s in splits.items() if s and leaves[k][1] < self.p.depth]
            if not able:
                break
            k = -max(able)[1]
            _, left, right = splits[k]
            depth = leaves[k][1] + 1
            leaves[k], splits[k] = (left, depth), self.best(left)
            leaves.append((right, depth))
            splits[len(leaves) - 1] = self.best(right)
        for rows, _ in leaves:
            g, h = self.sums(rows)
            g, h = g / UNIT, h / UNIT
            value = -math.copysign(max(abs(g) - self.p.l1, 0.0), g) / (h + self.p.l2)
            for i in rows:
                self.margin[i] += self.p.rate * value


@pytest.mark.parametrize("p, partitions, block_rows", [
    (Params(rounds=6, rate=0.3, leaves=8, depth=4, least_rows=10, l1=0.1, l2=0.5, features=1.0, rows=1.0, rows_every=0), 1, 16_384),
    (Params(rounds=4, rate=0.5, leaves=5, depth=8, least_rows=3, l1=2.0, l2=0.0, features=1.0, rows=1.0, rows_every=0), 4, 90),
])
def test_equals_the_plain_booster(spark, p, partitions, block_rows):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    with bin_rows(df, COLS, "label", "id", ["w"], block_rows) as store:
        assert store.count == 500 and all(len(e) <= 254 for e in store.edges)
        # thresholds between quantiles cannot be found: the plain booster sees the same values
        edges = store.edges
        snapped = []
        for r in rows:
            x = [None if v is None else (e[np.searchsorted(e, v)] if len(e) and v <= e[-1] else 1e9) for v, e in zip(r[2:6], edges)]
            snapped.append((*r[:2], *x, r[6]))
        plain, weighted = fit_batch(store, [Fit(p), Fit(p, weight="w")])
    x = np.array([[math.nan if v is None else v for v in r[2:6]] for r in rows])
    assert np.allclose(plain.margin(x), Plain(snapped, p).margin, atol=1e-9)
    assert np.allclose(weighted.margin(x), Plain(snapped, p, [r[6] for r in rows]).margin, atol=1e-9)
    assert max(len(t.feature) for t in plain.trees) <= 2 * p.leaves - 1
    again = BoostedTrees.from_json(plain.to_json())
    assert (again.margin(x) == plain.margin(x)).all() and again.importance() == plain.importance()
    scored = {r["id"]: r["p"] for r in plain.probability(df, "p").collect()}
    assert all(scored[r[0]] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-12) for r, m in zip(rows, plain.margin(x)))


def test_trees_do_not_depend_on_partitions_or_company(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    p = Params(rounds=5, features=0.6, rows=0.7, rows_every=2, least_rows=5)
    texts = set()
    for parts, block in ((1, 16_384), (3, 100), (7, 33)):
        with bin_rows(df.repartition(parts), COLS, "label", "id", block_rows=block) as store:
            alone = fit_batch(store, [Fit(p)])[0]
            crowd = fit_batch(store, [Fit(Params(rounds=3), columns=["b", "d"]), Fit(p), Fit(p, columns=["a"])])
            texts |= {alone.to_json(), crowd[1].to_json()}
            assert crowd[0].columns == ["b", "d"] and crowd[2].columns == ["a"] and len(crowd[0].trees) == 3
    assert len(texts) == 1


def test_patience_keeps_the_later_minimum(spark):
    rng = random.Random(9)
    rows = []
    for k in range(900):                      # the held-out rows contradict the strong feature at first, and agree with the weak one
        check = k % 3 == 0
        strong, weak = rng.choice([0.0, 1.0]), rng.choice([0.0, 1.0])
        y = int(rng.random() < (0.5 + 0.35 * (weak - 0.5)) if check else rng.random() < 0.5 + 0.45 * (strong - 0.5) + 0.35 * (weak - 0.5))
        rows.append((k, y, strong, weak, None, None, float(check)))
    df = spark.createDataFrame(rows, SCHEMA)
    p = Params(rounds=60, rate=0.1, leaves=2, depth=1, least_rows=1, l1=0.0, l2=0.0, features=1.0, rows=1.0, rows_every=0)
    held = (("w", "==", 1.0),)
    with bin_rows(df, COLS, "label", "id", ["w"]) as store:
        whole, short, wide = fit_batch(store, [Fit(p, (), held, patience=0), Fit(p, (), held, patience=3), Fit(p, (), held, patience=60)])
    assert len(whole.trees) == 60 and not whole.losses
    assert len(wide.losses) == 61
    best = min(range(1, 61), key=lambda k: (wide.losses[k], k))
    assert len(wide.trees) == best
    first = next(k for k in range(1, 62) if k == 61 or (k > 3 and min(wide.losses[1:k + 1]) not in wide.losses[k - 2:k + 1]))
    assert len(short.losses) <= first + 1 and len(short.trees) == min(range(1, len(short.losses)), key=lambda k: (short.losses[k], k))


def test_loss_that_rises_for_ten_rounds_and_falls_again():
    """The rule on its own: a minimum behind ten worse rounds is found with patience 50, not with 5."""
    losses = [0.7, 0.6, 0.5] + [0.5 + 0.01 * k for k in range(1, 11)] + [0.4, 0.39, 0.41] + [0.45] * 60

    def kept(patience):
        least, at = math.inf, 0
        for k, loss in enumerate(losses):
            if k and loss < least:
                least, at = loss, k
            elif k - at >= patience:
                break
        return at
    assert kept(50) == 14 and kept(5) == 2


def test_defined_cases(spark):
    p = Params(rounds=3, least_rows=1)
    one_class = spark.createDataFrame([(k, 1, float(k), None, None, None, 1.0) for k in range(20)], SCHEMA)
    nulls = spark.createDataFrame([(k, None if k % 3 else k % 2, float(k), math.nan, None, 1.0, None) for k in range(40)], SCHEMA)
    for df, n in ((one_class, 20), (nulls, 14), (one_class.limit(0), 0)):
        with bin_rows(df, COLS, "label", "id", ["w"]) as store:
            assert store.count == n
            m = fit_batch(store, [Fit(p, weight="w"), Fit(p, columns=[])])
        assert all(0 < r["p"] < 1 for x in m for r in x.probability(df).collect())
        assert not m[1].trees or all(len(t.feature) == 1 for t in m[1].trees)


def test_a_table_beyond_the_old_block_is_one_block_and_few_partitions_hold_the_rest(spark):
    """40,000 rows need no job per tree level; smaller blocks are added up in few partitions before they meet."""
    df = spark.range(0, 40_000, 1, 40).selectExpr("id", "cast(id % 2 as int) label", "cast(id % 7 as double) a", "cast(id % 11 as double) b")
    with bin_rows(df, ["a", "b"], "label", "id") as store:
        assert store.count == 40_000 and store.blocks.count() == 1
    with bin_rows(df, ["a", "b"], "label", "id", block_rows=500) as store:
        assert store.count == 40_000 and store.blocks.count() >= 40
        assert store.blocks.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


def test_of_two_children_the_smaller_is_summed():
    from postsignal.operators.boost import _Batch, _Growing
    g = _Growing(sums=[(0, 0, 10, 10), (0, 0, 7, 7), (0, 0, 3, 3)], depth=[0, 1, 1], split=[None] * 3, children=[(1, 2), None, None])
    assert g.summed([1, 2], [0]) == ([2], [(0, 0), (0, -1)])
    assert g.summed([1], [0]) == ([2], [(0, 0)])
    root, small = np.arange(24).reshape(4, 1, 6) * 3, np.arange(24).reshape(4, 1, 6)
    batch = _Batch.__new__(_Batch)
    _, whole = batch.whole(((0, 0), small), {0: (None, [2], None, [(0, 0), (0, -1)])}, root)
    assert (whole[:, 0] == root[:, 0] - small[:, 0]).all() and (whole[:, 1] == small[:, 0]).all()


def test_rows_and_hessians_are_summed_in_one_number():
    """Without weights two sums a feature give what three would; narrow features are counted together."""
    rng = np.random.default_rng(3)
    n, width = 70_000, np.array([3, 2, 4, 40, 256, 3])
    x = np.asfortranarray(np.stack([rng.integers(0, w, n) for w in width], axis=1).astype(np.uint8))
    rows, place = np.arange(n), np.sort(rng.integers(0, 3, n))
    g, h = rng.integers(-(1 << 24), 1 << 24, n).astype(float), rng.integers((1 << 22) - 2, (1 << 22) + 1, n).astype(float)
    got = boost._histogram(x, rows, place, 3, np.arange(6), width, g, h, None)
    assert got.shape == (3, 3, width.sum())                     # weights are not carried where there are none
    want = boost._histogram(x, rows, place, 3, np.arange(6), width, g, h, np.ones(n))
    assert (got == want[:3]).all()
    for f, at in enumerate(np.cumsum(width) - width):
        for node in range(3):
            of = [(place == node) & (x[:, f] == v) for v in range(width[f])]
            assert got[:, node, at:at + width[f]].T.tolist() == [[int(g[m].sum()), int(h[m].sum()), int(m.sum())] for m in of]


def test_a_table_of_one_block_needs_no_job_per_level(spark):
    df = spark.range(150_000).selectExpr("id", "cast(id % 3 = 0 as int) as label", "cast(id % 50 as double) as a")
    with bin_rows(df, ["a"], "label", "id") as store:
        assert store.count == 150_000 and store.blocks.count() == 1


def test_arrow_batches_of_one_partition_are_one_block(spark):
    """A partition of many Arrow batches is joined as many partitions are: else a small table takes a job per tree level."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame(_rows(), SCHEMA).coalesce(1)
        with bin_rows(df, COLS, "label", "id") as store:
            assert store.count == 500 and store.blocks.map(lambda b: len(b["y"])).collect() == [500]
        with bin_rows(df, COLS, "label", "id", block_rows=200) as store:
            assert store.blocks.map(lambda b: len(b["y"])).collect() == [200, 200, 100]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boosters_are_dealt_by_load():
    dealt = boost._dealt([1, 1, 1, 1, 4, 4], 3)
    assert sorted(i for g in dealt for i in g) == list(range(6)) and [4] in dealt and [5] in dealt
    assert boost._dealt([0, 0, 0], 3) == [[0], [1], [2]]


def test_few_rows_down_all_trees_together():
    from postsignal.operators.trees import FEW_ROWS, Tree
    rng = np.random.default_rng(3)
    trees = [Tree(np.array([0, 1, -1, -1, -1]), np.array([0.0, rng.normal(), math.inf, math.inf, math.inf]), np.array([t % 2 == 0, t % 3 == 0, False, False, False]),
                  np.array([1, 2, -1, -1, -1]), np.array([4, 3, -1, -1, -1]), rng.normal(size=5), np.ones(5), np.ones(5)) for t in range(7)]
    model = BoostedTrees(["a", "b"], 0.1, trees)
    x = rng.normal(size=(FEW_ROWS + 100, 2))
    x[rng.random(x.shape) < 0.2] = math.nan
    want = np.full(len(x), 0.1)
    for t in trees:
        want += t.value[t.leaves(x)]
    assert (model.margin(x[:50]) == want[:50]).all() and (model.margin(x) == want).all() and not len(model.margin(x[:0]))
