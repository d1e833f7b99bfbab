"""Fitted boosted trees: flat node tables, scoring as a column, importance, JSON.

A tree is a set of parallel arrays.  At an inner node a row goes left if its
value is at most ``threshold``; a missing value (null or NaN) takes the side that
``missing_left`` names.  ``value`` is a leaf's share of the margin (shrinkage
included), ``cover`` the rows (by weight) that reached the node in training.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_INT, _FLOAT = ("feature", "left", "right"), ("threshold", "value", "cover", "gain")


@dataclass
class Tree:
    feature: np.ndarray         # -1: leaf
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of ``x``."""
        node = np.zeros(len(x), dtype=np.int64)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            n, rows = open_.pop()
            if self.feature[n] < 0:
                node[rows] = n
            elif len(rows):
                v = x[:, self.feature[n]][rows]
                go_left = ~(v > self.threshold[n]) if self.missing_left[n] else v <= self.threshold[n]      # NaN compares false
                open_ += [(self.left[n], rows[go_left]), (self.right[n], rows[~go_left])]
        return node

    def to_json(self) -> dict:
        return {k: getattr(self, k).tolist() for k in (*_INT, *_FLOAT, "missing_left")}

    @classmethod
    def from_json(cls, d: dict) -> Tree:
        kinds = {**dict.fromkeys(_INT, np.int64), **dict.fromkeys(_FLOAT, np.float64), "missing_left": bool}
        return cls(**{k: np.array(v, dtype=kinds[k]) for k, v in d.items()})


FEW_ROWS = 1024                # rows that go down all trees together, a level at a time; more of them go down a tree at a time
STEP_CELLS = 1 << 16           # rows times trees that are sent down together, about


def _leaf_values(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """(trees, rows) values of the rows' leaves: all rows go down all trees a level at a time."""
    sizes = np.array([len(t.feature) for t in trees])
    start = np.cumsum(sizes) - sizes
    feature, threshold, left, right, value, missing_left = (np.concatenate([getattr(t, c) for t in trees]) for c in ("feature", "threshold", "left", "right", "value", "missing_left"))
    leaf, own, first = feature < 0, np.arange(len(feature)), np.repeat(start, sizes)
    children = np.stack([np.where(leaf, own, left + first), np.where(leaf, own, right + first)], axis=1).ravel()       # a leaf is its own child
    feature, missing_right = np.where(leaf, 0, feature), ~missing_left.astype(bool) & ~leaf
    missing = bool(np.isnan(x).any())
    cells, row = x.ravel(), np.arange(len(x)) * x.shape[1]
    node = np.repeat(start[:, None], len(x), axis=1)
    while True:
        v = cells.take(feature.take(node) + row)
        go_right = v > threshold.take(node)                      # NaN compares false
        if missing:
            go_right |= np.isnan(v) & missing_right.take(node)
        below = children.take(2 * node + go_right)
        if (below == node).all():
            return value.take(node)
        node = below


@dataclass
class BoostedTrees:
    """``base`` plus the sum of the trees' leaf values is the log-odds of label 1."""
    columns: list[str]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)      # held-out loss before each round, if any were held out

    @property
    def best_round(self) -> int:
        return len(self.trees)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not x.size or len(x) > FEW_ROWS:
            for t in self.trees:
                out += t.value[t.leaves(x)]
            return out
        x = np.ascontiguousarray(x)
        step = max(1, STEP_CELLS // len(x))
        for at in range(0, len(self.trees), step):
            for values in _leaf_values(self.trees[at:at + step], x):
                out += values
        return out

    def margin_column(self) -> Column:
        """The margin as a column over the model's feature columns; null and NaN are missing values."""
        model = self

        @F.arrow_udf("double")
        def margin(*cols: pa.Array) -> pa.Array:
            return pa.array(model.margin(feature_matrix(cols)))

        return margin(*[F.col(f"`{c}`").cast("double") for c in self.columns])

    def probability(self, df: DataFrame, out: str = "p") -> DataFrame:
        if not self.columns or not self.trees:
            return df.withColumn(out, F.lit(float(1 / (1 + np.exp(-self.base)))))
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin_column())))

    def importance(self) -> dict[str, float]:
        """Share of every feature in the gain of all splits (0 where nothing was split)."""
        total = np.zeros(len(self.columns))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        whole = total.sum()
        return dict(zip(self.columns, (total / whole if whole > 0 else total).tolist()))

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "base": self.base, "losses": self.losses, "trees": [t.to_json() for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        d = json.loads(text)
        return cls(d["columns"], d["base"], [Tree.from_json(t) for t in d["trees"]], d["losses"])


def chosen_probability(models: list[BoostedTrees], which: Column) -> Column:
    """Probability by ``models[which]``; null where ``which`` is null or names none."""
    columns = list(dict.fromkeys(c for m in models for c in m.columns))

    @F.arrow_udf("double")
    def margin(index: pa.Array, *cols: pa.Array) -> pa.Array:
        at = index.fill_null(-1).to_numpy(zero_copy_only=False)
        x = feature_matrix(cols) if cols else np.zeros((len(at), 0))
        out = np.full(len(at), np.nan)
        for k, m in enumerate(models):
            rows = np.flatnonzero(at == k)
            if len(rows):
                out[rows] = m.margin(x[np.ix_(rows, [columns.index(c) for c in m.columns])])
        return pa.array(out, mask=np.isnan(out))

    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(which, *[F.col(f"`{c}`").cast("double") for c in columns])))


def trial_margins(models: list[list[BoostedTrees]], which: Column) -> Column:
    """For each list of models the margin by its ``which``-th one, as an array."""
    columns = list(dict.fromkeys(c for trial in models for m in trial for c in m.columns))
    places = [[[columns.index(c) for c in m.columns] for m in trial] for trial in models]

    @F.arrow_udf("array<double>")
    def margins(index: pa.Array, *cols: pa.Array) -> pa.Array:
        at = index.fill_null(-1).to_numpy(zero_copy_only=False)
        x = feature_matrix(cols) if cols else np.zeros((len(at), 0))
        out = np.full((len(at), len(models)), np.nan)
        for k in range(max((len(t) for t in models), default=0)):
            rows = np.flatnonzero(at == k)
            if len(rows):
                own = x[rows]
                for t, trial in enumerate(models):
                    out[rows, t] = trial[k].margin(own[:, places[t][k]])
        return pa.array(list(out), pa.list_(pa.float64()))

    return margins(which, *[F.col(f"`{c}`").cast("double") for c in columns])


def feature_matrix(cols) -> np.ndarray:
    """(rows, columns) doubles of Arrow arrays, nulls as NaN."""
    return np.stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in cols]).T       # a column's values stand together
