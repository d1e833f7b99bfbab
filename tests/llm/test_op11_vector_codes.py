import math
import random

import numpy as np
import pytest

from postsignal.llm.balls import Assignment, BallTree, nearest_entry
from postsignal.llm.op11_vector_codes import CodeParams, compress, with_label_error


def _brute(rows, p):
    """Codes, errors and codebooks by the definition, over (id, label, vector) rows with usable vectors of one length."""
    width = len(rows[0][2]) // p.parts
    cut = [[[math.floor(p.scale * x) for x in v[k * width:(k + 1) * width]] for k in range(p.parts)] for _, _, v in rows]
    first = sorted({r[0]: i for i, r in reversed(list(enumerate(rows))) if r[0] is not None}.items())[:p.entries]
    books = [[list(cut[i][k]) for _, i in first] for k in range(p.parts)]

    def near(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[k]))
    for _ in range(p.rounds):
        for k in range(p.parts):
            of = {}
            for c in cut:
                of.setdefault(near(k, c[k])[1], []).append(c[k])
            for j, xs in of.items():
                books[k][j] = [sum(x) // len(xs) for x in zip(*xs)]
    got = [[near(k, c[k]) for k in range(p.parts)] for c in cut]
    return sorted((r[0] is None, r[0] or 0, "".join(f"{j:02x}" for _, j in g), sum(d for d, _ in g)) for r, g in zip(rows, got)), books


def _rows(n=160, dim=8, seed=1):
    rng = random.Random(seed)
    rows = [(k * 3, rng.choice([0, 1, None]), [round(rng.gauss(0, 1), 2) for _ in range(dim)]) for k in range(n)]
    rows += [(1000 + k, 2, [0.25] * dim) for k in range(60)]                     # one place
    rows += [(2000 + k, 3, [float(rng.randint(-2, 2)) / 256 for _ in range(dim)]) for k in range(60)]      # many ties
    return rows + [(None, 1, [0.5] * dim)]


SCHEMA = "vec_id long, label int, embedding array<double>, code string, id int"


@pytest.mark.parametrize("parts, entries, chunk, leaf", [(4, 16, 16_384, 24), (2, 64, 50, 3), (8, 3, 7, 1)])
def test_against_the_definition(spark, parts, entries, chunk, leaf):
    rows = _rows()
    bad = [(5, 1, None), (6, 1, []), (7, 1, [1.0]), (8, None, [math.nan] * 8), (9, 1, [math.inf] + [0.0] * 7), (10, 2, [None] + [0.0] * 7)]
    p = CodeParams(parts=parts, entries=entries, chunk=chunk, leaf=leaf)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], SCHEMA).repartition(3)
    codes = compress(df, params=p)
    want, books = _brute(rows, p)
    assert codes.codebooks == books
    got = with_label_error(codes.rows).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["code"], r["error"]) for r in got) == want
    sums = {}
    for r in got:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def test_many_labels_meet_their_sums(spark):
    rows = [(k, k // 2 if k < 3000 else None, "", 1 + k % 3) for k in range(4000)]
    got = with_label_error(spark.createDataFrame(rows, "id long, label long, code string, error long")).collect()
    sums = {}
    for _, label, _, e in rows:
        sums[label] = sums.get(label, 0) + e
    assert len(got) == 4000 and all(r["label_error"] == sums[r["label"]] for r in got)


def test_repeated_ids_few_ids_empty(spark):
    p = CodeParams(parts=2, entries=8, rounds=1)
    rows = [(1, 0, [0.0, 1.0]), (1, 0, [0.0, 1.0]), (1, 0, [3.0, 1.0]), (2, None, [5.0, 5.0])]
    codes = compress(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), params=p)
    assert codes.codebooks == _brute(rows, p)[1] and codes.rows.count() == 4
    empty = compress(spark.createDataFrame([], SCHEMA), params=p)
    assert with_label_error(empty.rows).count() == 0 and empty.codebooks == [[], []]
    nobody = compress(spark.createDataFrame([(None, 0, [1.0, 2.0], "", 0)], SCHEMA), params=p)
    assert [(r["code"], r["error"]) for r in with_label_error(nobody.rows).collect()] == [("", None)]
    huge = compress(spark.createDataFrame([(k, 0, [1e300 * (-1) ** k, float(k)], "", 0) for k in range(9)], SCHEMA), params=p)
    assert huge.rows.filter("error >= 0").count() == 9


def test_uneven_length_is_filled(spark):
    rows = [(k, 0, [k / 7, -k / 3, k % 5 / 2]) for k in range(40)]
    p = CodeParams(parts=2, entries=4)
    codes = compress(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), params=p)
    want, books = _brute([(i, lab, [*v, 0.0]) for i, lab, v in rows], p)
    assert codes.codebooks == books
    assert sorted((False, r["id"], r["code"], r["error"]) for r in codes.rows.collect()) == want


@pytest.mark.parametrize("scale", [1, 40, 1 << 22])
def test_tree_keeps_its_promises(scale):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-9, 9, (700, 3)) * scale, np.tile(rng.integers(-9, 9, (1, 3)) * scale, (300, 1)), (rng.standard_normal((500, 3)) * 9).astype(np.int64) * scale])
    t = BallTree.load(BallTree(x, 10).dump())
    assert sorted(t.place.tolist()) == list(range(len(x))) and (t.points == x[t.place]).all()
    for n in range(len(t.lo)):
        own = t.points[t.lo[n]:t.hi[n]]
        assert (t.total[n] == own.sum(0)).all()
        assert np.sqrt(((own - t.centre[n]) ** 2).sum(1)).max() <= t.radius[n] * (1 + 1e-9)
        if t.left[n] >= 0:
            assert (t.lo[t.left[n]], t.hi[t.left[n]], t.hi[t.right[n]]) == (t.lo[n], t.lo[t.right[n]], t.hi[n])
    entries = x[rng.permutation(len(x))[:20]]
    a = Assignment(t, entries)
    d = ((t.points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(-1)
    want = np.array([min(range(20), key=lambda j: (row[j], j)) for row in d])
    assert (a.code == want).all() and (nearest_entry(t.points, entries) == want).all()
    assert (a.count == np.bincount(want, minlength=20)).all()
    assert all((a.total[j] == t.points[want == j].sum(0)).all() for j in range(20))


def test_balls_are_owned_whole():
    rng = np.random.default_rng(3)
    centres = rng.integers(-5000, 5000, (12, 4))
    x = (centres[rng.integers(0, 12, 6000)] + rng.integers(-40, 40, (6000, 4))).astype(np.int64)
    a = Assignment(BallTree(x), centres.astype(np.int64))
    assert a.owned > 0.95 * len(x)
