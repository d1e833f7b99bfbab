"""Leaf-wise gradient boosting on Spark (ML-7, ML-8): many boosters in step over one binned table.

* **Binned feature store.**  Quantile edges of all features come from one
  aggregate; a row is then one byte per feature (the last number of a feature
  means "missing").  Rows are packed into blocks of ``block_rows`` and stay on the
  executors with their margins, kept by ``persist`` and a checkpoint every
  ``CHECKPOINT_ROUNDS`` rounds.  A block holds ``ALONE_BYTES`` of bins at most.
* **Levels, not splits.**  All boosters of a batch (folds, trials, sizes of a
  learning curve) grow their next tree together, one Spark job per tree level (a
  table of a single block has nothing to exchange between levels and rounds, so there
  a job takes every booster ``CHECKPOINT_ROUNDS`` rounds on, by the same steps).
  A block sums gradients, hessians and counts (and weights, if any) per (booster, node, feature, bin);
  blocks meet by ``reduceByKey`` over (booster, run of features), and the best split
  of every node is found there.  The driver receives one split per node and run.
* **Best leaf first.**  A tree grows to ``num_leaves`` by largest gain.  A level only
  needs the nodes that best-first growth could still split: a node that is not
  among the ``num_leaves - 1`` best of what is known cannot become one of them
  when deeper nodes are added, so levels cost no more than the tree needs.
* **Regularisation** as in the usual second-order objective: ``lambda_l1`` shrinks
  a node's gradient sum towards 0, ``lambda_l2`` is added to its hessian sum;
  missing values take the side with the larger gain; ``bagging_fraction`` rows are
  drawn anew every ``bagging_freq`` rounds by a hash of the row's key.
* **Patience.**  The held-out loss of every round falls out of the next round's first
  job; a booster ends when ``patience`` rounds brought no new minimum and keeps the
  trees up to the minimum.

Gradients are summed as whole numbers of 2**-24, so the trees do not depend
on how rows are dealt to blocks and partitions.

Defined cases: rows with a null label are left out; a table without both labels, or
without features, gives a model without trees (the base rate, held within 1e-6 and
1 - 1e-6); all-null features are never split; weights null count as 1.
"""

from __future__ import annotations

import math
import sys
import types
import uuid
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .trees import BoostedTrees, Tree, feature_matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------------------
# The reference's default booster parameters.
DEFAULT_PARAMS = {
    "learning_rate": 0.05, "feature_fraction": 0.9, "bagging_fraction": 0.8, "bagging_freq": 5,
    "lambda_l1": 0.1, "lambda_l2": 0.1, "min_child_samples": 20, "max_depth": 8, "num_leaves": 31,
    "random_state": 42,
}
# ---------------------------------------------------------------------------
DEFAULT_ROUNDS = 100
MAX_BIN = 255                  # value bins of a feature, at most; one more number stands for "missing"
BLOCK_ROWS = 16_384
ALONE_ROWS, ALONE_BYTES = 1 << 20, 1 << 26     # a table of so many rows and bytes of bins, at most, is one block: boosters are dealt to tasks, not rows
STEP_ROWS = 65_536             # rows of a block of a larger table
PARTITION_BLOCKS = 64          # blocks of a partition, at most
CHECKPOINT_ROUNDS = 25
LEAST_HESSIAN = 1e-3
UNIT = float(1 << 24)          # gradients are summed in units of 2**-24
FEATURE_RUN = 32               # features of a reduced histogram
ALONE_RUN = 128                # features of a histogram that stays in its task
BATCHES = 8                    # batches that a worker process keeps unpacked
JOINT_CELLS = 256              # cells of features that are counted in one go, at most
PACKED_ROWS, PACKED_UNIT = (1 << 15) - 1, float(1 << 37)       # rows summed in one number with their hessians


@dataclass(frozen=True)
class Params:
    rounds: int = DEFAULT_ROUNDS
    rate: float = 0.05
    leaves: int = 31
    depth: int = 8
    least_rows: int = 20
    l1: float = 0.1
    l2: float = 0.1
    features: float = 0.9
    rows: float = 0.8
    rows_every: int = 5        # 0: no row sampling
    seed: int = 42

    @classmethod
    def of(cls, given: dict | None = None) -> Params:
        """From the usual names of these parameters; names it does not know are ignored."""
        p = {**DEFAULT_PARAMS, **(given or {})}

        def first(*names, default):
            return next((p[n] for n in names if p.get(n) is not None), default)
        depth = int(first("max_depth", default=-1))
        leaves = int(first("num_leaves", default=31))
        return cls(int(first("n_estimators", "num_boost_round", default=DEFAULT_ROUNDS)), float(first("learning_rate", default=0.1)), leaves,
                   leaves - 1 if depth <= 0 else depth, int(first("min_data_in_leaf", "min_child_samples", default=20)),
                   float(first("lambda_l1", "reg_alpha", default=0.0)), float(first("lambda_l2", "reg_lambda", default=0.0)),
                   float(first("feature_fraction", "colsample_bytree", default=1.0)), float(first("bagging_fraction", "subsample", default=1.0)),
                   int(first("bagging_freq", "subsample_freq", default=0)), int(first("random_state", default=42)))


LEARN, CHECK = 1, 2            # what a row is to a booster; 0: nothing
_TESTS = {"==": np.equal, "!=": np.not_equal, "<=": np.less_equal, ">": np.greater}


@dataclass
class Fit:
    """One booster of a batch.  It learns from the rows for which all of ``learn`` holds, and its loss is taken over those of
    ``check`` (if given); conditions are (extra column, ``==``/``!=``/``<=``/``>``, number)."""
    params: Params
    learn: tuple = ()
    check: tuple | None = None
    columns: list[str] | None = None      # all of the store, if None
    weight: str | None = None             # an extra column of the store
    patience: int = 0                     # 0: all rounds are kept


def roles(block: dict, learn: tuple, check: tuple | None) -> np.ndarray:
    """LEARN, CHECK or 0 for every row of a block."""
    def where(tests):
        out = np.ones(len(block["y"]), dtype=bool)
        for column, test, number in tests:
            out &= _TESTS[test](block[column], number)
        return out

    held = where(check) if check is not None else np.zeros(len(block["y"]), dtype=bool)
    return np.where(held, CHECK, np.where(where(learn), LEARN, 0)).astype(np.int8)


@dataclass
class Store:
    """Binned rows: ``blocks`` is an RDD of dicts of arrays (x, y, uid and the extra columns)."""
    columns: list[str]
    edges: list[np.ndarray]
    blocks: object
    count: int

    def release(self) -> None:
        self.blocks.unpersist()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.release()


SKETCH = 2048                  # values of a feature that a task hands on
_SKETCH = pa.schema([("feature", pa.int32()), ("part", pa.int32()), ("value", pa.list_(pa.float64())), ("n", pa.list_(pa.float64()))])
_SKETCH_DDL = "feature int, part int, value array<double>, n array<double>"


def _condensed(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``SKETCH`` of the sorted values with their numbers of rows: all of them, or those at even ranks."""
    value, at = np.unique(value, return_inverse=True)
    n = np.bincount(at, n, len(value))
    if len(value) <= SKETCH:
        return value, n
    upto = np.cumsum(n)
    cut = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], SKETCH + 1)[1:]))
    cut = np.minimum(cut, len(value) - 1)
    return value[cut], np.diff(np.concatenate([[0.0], upto[cut]]))


def _sketched(batches):
    """A partition's condensed values of every feature (missing ones left out)."""
    from pyspark import TaskContext
    kept, part = {}, TaskContext.get().partitionId() % 64
    for b in batches:
        for f, c in enumerate(b.columns):
            v = c.to_numpy(zero_copy_only=False).astype(np.float64)
            v = v[~np.isnan(v)]
            old = kept.get(f, (v[:0], v[:0]))
            kept[f] = _condensed(np.concatenate([old[0], v]), np.concatenate([old[1], np.ones(len(v))]))
    if kept:
        yield pa.RecordBatch.from_pydict({"feature": list(kept), "part": [part] * len(kept), "value": [v for v, _ in kept.values()], "n": [n for _, n in kept.values()]}, schema=_SKETCH)


def _merged(rows: pa.Table) -> pa.Table:
    v, n = (np.concatenate([x.values.to_numpy() for x in rows[c]]) for c in ("value", "n"))
    v, n = _condensed(v, n)
    return pa.Table.from_pydict({"feature": [rows["feature"][0].as_py()], "part": [0], "value": [v], "n": [n]}, schema=_SKETCH)


def _edges(most: int):
    def run(batches):
        for b in batches:
            edges = []
            for value, n in zip(b["value"], b["n"]):
                v, upto = value.values.to_numpy(), np.cumsum(n.values.to_numpy())
                if len(v) > most:
                    v = v[np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, most) / most))]
                    edges.append(v if v[-1] < value.values[-1].as_py() else v[:-1])
                else:
                    edges.append(v[:-1])
            yield pa.RecordBatch.from_arrays([b["feature"], pa.array(edges, pa.list_(pa.float64()))], names=["feature", "edges"])
    return run


def bin_edges(df: DataFrame, columns: list[str], most: int = MAX_BIN) -> list[np.ndarray]:
    """Upper edges of every feature's value bins but the last: its quantiles, or all its values where they are few.

    Tasks condense their values, which meet per feature in two steps; the driver gets the edges."""
    if not columns:
        return []
    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).mapInArrow(_sketched, _SKETCH_DDL)
    whole = parts.groupBy("feature", "part").applyInArrow(_merged, _SKETCH_DDL).groupBy("feature").applyInArrow(_merged, _SKETCH_DDL)
    found = {r["feature"]: r["edges"] for r in whole.mapInArrow(_edges(most), "feature int, edges array<double>").collect()}
    return [np.array(found.get(i, []), dtype=np.float64) for i in range(len(columns))]


def _pack(edges: list[np.ndarray], extra: list[str], block_rows: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                part = b.slice(at, block_rows)
                raw = feature_matrix(part.columns[2 + len(extra):]) if edges else np.zeros((part.num_rows, 0))
                x = np.empty(raw.shape, dtype=np.uint8)
                for f, e in enumerate(edges):
                    x[:, f] = np.where(np.isnan(raw[:, f]), len(e) + 1, np.searchsorted(e, raw[:, f], side="left"))
                cells = [x, *[np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in part.columns[:2 + len(extra)]]]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["x", "uid", "y", *extra])
    return run


def bin_rows(df: DataFrame, columns: list[str], label: str, key: str | None = None, extra: list[str] | None = None, block_rows: int | None = None,
             edges_from: DataFrame | None = None) -> Store:
    """The binned store of ``df`` (rows with a null label left out).  ``key`` names the rows for row sampling; ``extra``: numeric
    columns for roles and weights (read as doubles).  Edges come from ``edges_from``, or from all rows."""
    extra = list(extra or [])
    df = df.filter(F.col(label).isNotNull())
    edges = bin_edges(df if edges_from is None else edges_from, columns)
    uid = F.xxhash64(*([F.col(key)] if key else [F.col(f"`{c}`") for c in [*columns, label]]))
    width = len(columns)
    rows = df.select(uid.alias("_uid"), F.col(label).cast("double").alias("_y"), *[F.coalesce(F.col(c).cast("double"), F.lit(1.0)).alias(f"_e{i}") for i, c in enumerate(extra)],
                     *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    packed = rows.mapInArrow(_pack(edges, extra, block_rows or BLOCK_ROWS), ", ".join(f"`{c}` binary" for c in ("x", "uid", "y", *extra)))

    def block(row):
        n = len(row["uid"]) // 8
        return {"x": np.asfortranarray(np.frombuffer(row["x"], dtype=np.uint8).reshape(n, width)), "uid": np.frombuffer(row["uid"], dtype=np.uint64),
                "y": np.frombuffer(row["y"]), **{c: np.frombuffer(row[c]) for c in extra}}

    blocks = packed.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = blocks.mapPartitions(lambda it: [[len(b["y"]) for b in it]]).map(lambda n: (sum(n), len(n))).collect()      # two numbers a partition
    count = sum(rows for rows, _ in sizes)
    alone = min(ALONE_ROWS, ALONE_BYTES // max(1, width))
    block_rows = block_rows or (alone if count <= alone else STEP_ROWS)
    full = max(1, -(-count // block_rows))
    # few full blocks instead of many small ones, and few partitions: a task adds its blocks up before they meet others
    fewer = min(full, max(2 * blocks.context.defaultParallelism, -(-full // PARTITION_BLOCKS)), len(sizes))
    # an only partition may hold many blocks, too: one for every Arrow batch
    if fewer < len(sizes) or any(n > -(-rows // block_rows) for rows, n in sizes):
        small = blocks.coalesce(fewer).mapPartitions(_joined(block_rows)).persist(StorageLevel.MEMORY_AND_DISK)
        small.count()
        blocks.unpersist()
        blocks = small
    return Store(list(columns), edges, blocks, count)


def _joined(block_rows: int):
    def run(blocks):
        held, n = [], 0
        for b in blocks:
            if held and n + len(b["y"]) > block_rows:
                yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                held, n = [], 0
            held.append(b)
            n += len(b["y"])
        if held:
            yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    return run


# ---- one tree, as it grows


@dataclass
class _Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple                # (gradient, hessian, rows, weight) sums, whole numbers
    right: tuple

    def order(self) -> tuple:
        return -self.gain, self.feature, self.bin, not self.missing_left


@dataclass
class _Growing:
    """Nodes in the order of their making: a node's sums, its depth, its best split once known, its children once taken."""
    sums: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    split: list = field(default_factory=list)
    children: list = field(default_factory=list)
    asked: int = 0

    def add(self, sums: tuple, depth: int) -> int:
        self.sums.append(sums)
        self.depth.append(depth)
        self.split.append(None)
        self.children.append(None)
        return len(self.sums) - 1

    def choose(self, p: Params) -> None:
        """Best leaf first over what is known; children of the chosen splits become nodes."""
        heap, taken, n = [(self.split[0].order(), 0)] if self.split[0] else [], set(), 0
        while heap and n < p.leaves - 1:
            _, node = heappop(heap)
            taken.add(node)
            n += 1
            if self.children[node] is None:
                s = self.split[node]
                self.children[node] = (self.add(s.left, self.depth[node] + 1), self.add(s.right, self.depth[node] + 1))
            for c in self.children[node]:
                if self.split[c]:
                    heappush(heap, (self.split[c].order(), c))
        self.taken = taken

    def frontier(self, p: Params) -> list[int]:
        """Nodes that have not been looked at, whose parent is taken and which are large and high enough to split."""
        new = [n for n in range(self.asked, len(self.sums)) if self.depth[n] < p.depth and self.sums[n][2] >= 2 * p.least_rows]
        self.asked = len(self.sums)
        return new

    def summed(self, nodes: list[int], before: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
        """The nodes whose rows are summed, and for each of ``nodes`` the place of such a node and -1, or the place of its parent in
        ``before``: of two children the smaller one is summed, the other has what its parent has beyond it."""
        parent = {c: (n, pair[1 - side]) for n, pair in enumerate(self.children) if pair for side, c in enumerate(pair)}
        place, ways = {}, []
        for n in nodes:
            up, twin = parent[n]
            small = n if up not in before or (self.sums[n][2], n) <= (self.sums[twin][2], twin) else twin
            ways.append((place.setdefault(small, len(place)), -1 if small == n else before.index(up)))
        return list(place), ways

    def routes(self, taken_only: bool = True) -> dict:
        """Arrays that send a row of bins to its node: inner nodes are those whose split is taken."""
        n = len(self.sums)
        inner = [i in self.taken and self.children[i] is not None for i in range(n)] if taken_only else [c is not None for c in self.children]
        return {"feature": np.array([self.split[i].feature if inner[i] else -1 for i in range(n)]), "bin": np.array([self.split[i].bin if inner[i] else 0 for i in range(n)]),
                "missing_left": np.array([bool(inner[i] and self.split[i].missing_left) for i in range(n)]),
                "left": np.array([self.children[i][0] if inner[i] else -1 for i in range(n)]), "right": np.array([self.children[i][1] if inner[i] else -1 for i in range(n)])}

    def plain(self) -> tuple:
        """The state without classes, for the way to the driver."""
        return self.sums, self.depth, [vars(s) if s else None for s in self.split], self.children, self.asked, self.taken

    @classmethod
    def of(cls, plain: tuple) -> _Growing:
        sums, depth, split, children, asked, taken = plain
        g = cls(sums, depth, [_Split(**s) if s else None for s in split], children, asked)
        g.taken = taken
        return g

    def learn(self, nodes: list[int], splits: dict, p: Params) -> None:
        """The best splits of the nodes asked (by place) are known now."""
        for n, s in splits.items():
            self.split[nodes[n]] = s
        self.choose(p)

    def valued(self, p: Params) -> dict:
        """The routes of the rows' bins, with leaf values."""
        r = self.routes()
        return {**r, "value": np.array([0.0 if f >= 0 else p.rate * leaf_value(s[0] / UNIT, s[1] / UNIT, p) for f, s in zip(r["feature"], self.sums)])}

    def finish(self, p: Params, edges: list[np.ndarray]) -> tuple[Tree, dict]:
        """The tree, and its routes with leaf values."""
        r = self.valued(p)
        value = r["value"]
        inner = r["feature"] >= 0
        threshold = np.array([math.inf if f < 0 or b >= len(edges[f]) else edges[f][b] for f, b in zip(r["feature"], r["bin"])])
        gain = np.array([self.split[i].gain if inner[i] else 0.0 for i in range(len(inner))])
        reach = np.zeros(len(inner), dtype=bool)                  # nodes made for splits that were not taken in the end are left out
        reach[0] = True
        for i in range(len(inner)):
            if inner[i] and reach[i]:
                reach[[r["left"][i], r["right"][i]]] = True
        number = np.cumsum(reach) - 1
        child = lambda c: np.where(inner, number[np.maximum(c, 0)], -1)[reach]
        cover = np.array([s[3] / UNIT for s in self.sums])
        tree = Tree(r["feature"][reach], threshold[reach], r["missing_left"][reach], child(r["left"]), child(r["right"]), value[reach], cover[reach], gain[reach])
        return tree, r


def leaf_value(gradient: float, hessian: float, p: Params) -> float:
    shrunk = math.copysign(max(abs(gradient) - p.l1, 0.0), gradient)
    return -shrunk / (hessian + p.l2) if hessian + p.l2 > 0 else 0.0


def rows_at(x: np.ndarray, missing: np.ndarray, r: dict, ends: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of rows of bins that stand at nodes, those that end at each node; ``missing``: each feature's number for a missing value."""
    out, open_ = {}, list(ends.items())
    while open_:
        n, rows = open_.pop()
        f = r["feature"][n]
        if f < 0:
            out[int(n)] = rows
        elif len(rows):
            v = x[:, f][rows]
            left = v <= r["bin"][n]                              # the number for "missing" is above all bins
            if r["missing_left"][n]:
                left |= v == missing[f]
            open_ += [(r["left"][n], rows[left]), (r["right"][n], rows[~left])]
    return out


def bins_to_nodes(x: np.ndarray, missing: np.ndarray, r: dict) -> np.ndarray:
    """Node of every row of bins."""
    node = np.zeros(len(x), dtype=np.int64)
    for n, rows in rows_at(x, missing, r, {0: np.arange(len(x))}).items():
        node[rows] = n
    return node


# ---- histograms and splits, on the executors


def _gradients(block: dict, margin: np.ndarray, fit: Fit, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Gradient, hessian and weight of these rows, whole numbers of 2**-24; no weight stands for 1."""
    p = 1 / (1 + np.exp(-margin[rows]))
    if not fit.weight:
        return np.rint((p - block["y"][rows]) * UNIT), np.rint(p * (1 - p) * UNIT), None
    w = block[fit.weight][rows]
    return np.rint((p - block["y"][rows]) * w * UNIT), np.rint(p * (1 - p) * w * UNIT), np.rint(w * UNIT)


def _drawn(uid: np.ndarray, p: Params, turn: int) -> np.ndarray:
    """Rows of the sample that holds for ``rows_every`` rounds from ``turn`` on."""
    h = uid ^ np.uint64((p.seed * 0x9E3779B97F4A7C15 + turn // p.rows_every * 0xD1342543DE82EF95) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)) < np.uint64(int(p.rows * (1 << 53)))


def _together(width: np.ndarray) -> list[list[int]]:
    """Places of features that are counted in one go: narrow ones by the product of their cells."""
    out, size = [], JOINT_CELLS + 1
    for i, wide in enumerate(width.tolist()):
        if size * wide <= JOINT_CELLS:
            out[-1].append(i)
            size *= wide
        else:
            out.append([i])
            size = wide
    return out


def _histogram(x: np.ndarray, rows: np.ndarray | None, place: np.ndarray | None, nodes: int, features: np.ndarray, width: np.ndarray, g, h, w) -> np.ndarray:
    """(4, nodes, cells) sums of gradient, hessian, rows and weight (three where ``w`` is None: each row's is 1); a feature's cells stand
    together, in the order of ``features``.  ``place``, ``g``, ``h`` and ``w`` go with ``rows`` (None: all rows); few features at a time, so
    that their numbers stay near."""
    together, start = _together(width), np.cumsum(width) - width
    if w is not None:
        both = [_counted(x, rows, place, nodes, features, width, start, together, v) for v in (g + 1j * h, 1 + 1j * w)]
        return np.stack([part.astype(np.int64) for b in both for part in (b.real, b.imag)])
    # without weights a hessian is 2**22 at most: hessians and rows are summed in one number, exact for so many rows
    out = np.zeros((3, nodes, int(width.sum())), dtype=np.int64)
    for at in range(0, len(g), PACKED_ROWS):
        some = slice(at, at + PACKED_ROWS)
        both = _counted(x[some] if rows is None else x, rows if rows is None else rows[some], None if place is None else place[some], nodes, features, width, start,
                        together, g[some] + 1j * (h[some] + PACKED_UNIT))
        n = np.floor(both.imag * (1 / PACKED_UNIT))
        out[0] += both.real.astype(np.int64)
        out[1] += (both.imag - n * PACKED_UNIT).astype(np.int64)
        out[2] += n.astype(np.int64)
    return out


def _counted(x: np.ndarray, rows: np.ndarray | None, place: np.ndarray | None, nodes: int, features: np.ndarray, width: np.ndarray, start: np.ndarray,
             together: list[list[int]], values: np.ndarray) -> np.ndarray:
    """(nodes, cells) sums of complex ``values``: two sums in one pass over the rows."""
    out = np.empty((nodes, int(width.sum())), dtype=complex)
    places: dict[int, np.ndarray] = {}                             # the nodes' first cells, by the cells of a node

    def column(i: int) -> np.ndarray:
        own = x[:, features[i]]
        return own if rows is None else own.take(rows)

    for some in together:
        wide = [int(width[i]) for i in some]
        size = math.prod(wide)
        cell = column(some[0])
        for i, by in zip(some[1:], wide[1:]):
            cell = cell * np.uint8(by) + column(i)                 # below JOINT_CELLS
        cell = cell.astype(np.int64)
        if place is not None:
            if size not in places:
                places[size] = place * size
            cell += places[size]
        found = np.zeros(nodes * size, dtype=complex)
        np.add.at(found, cell, values)
        found = found.reshape(nodes, *wide)
        for k, i in enumerate(some):
            others = tuple(1 + j for j in range(len(some)) if j != k)
            out[:, start[i]:start[i] + wide[k]] = found.sum(axis=others) if others else found
    return out


def _best(hist: np.ndarray, features: np.ndarray, width: np.ndarray, p: Params) -> list:
    """The best split of every node among these features (the fields of ``_Split``), or None.  A node at a time, so that its numbers stay near."""
    start = np.cumsum(width) - width
    last = start + width - 1                                       # a feature's cell of missing values
    feature = np.repeat(np.arange(len(features)), width)
    valued = np.ones(len(feature), dtype=bool)
    valued[last] = False                                           # "missing" is no bin
    least = max(1, p.least_rows)
    return [_node_best(sums, features, width, start, last, feature, valued, least, p) for sums in hist.transpose(1, 0, 2)]


def _node_best(sums: np.ndarray, features: np.ndarray, width: np.ndarray, start: np.ndarray, last: np.ndarray, feature: np.ndarray, valued: np.ndarray, least: int,
               p: Params) -> tuple | None:
    own = sums[:3]
    whole = own[:, :last[0] + 1].sum(axis=1)                       # every row is in one cell of a feature
    if whole[2] < 2 * least:
        return None
    upto = np.cumsum(own, axis=1)
    upto -= np.repeat(upto.take(start, axis=1) - own.take(start, axis=1), width, axis=1)       # up to a cell, of its feature
    lost = own.take(last, axis=1)
    parent = _score(whole, p)
    best: tuple = (-np.inf,)
    for side in (0, 1):                                            # missing to the right, to the left
        # a threshold after a bin that has rows (after an empty one it cuts the same)
        if side:
            some = np.flatnonzero(lost[2])
            if not len(some):
                continue
            at = np.concatenate([np.arange(start[f], last[f]) for f in some])
            at = at[own[2].take(at) > 0]
            left = upto.take(at, axis=1) + lost.take(feature.take(at), axis=1)
            ok = np.flatnonzero((left[2] >= least) & (left[2] <= whole[2] - least))
            at, g, h = at[ok], left[0].take(ok), left[1].take(ok)
        else:
            at = np.flatnonzero(valued & (own[2] > 0) & (upto[2] >= least) & (upto[2] <= whole[2] - least))
            g, h = upto[0].take(at), upto[1].take(at)
        ok = np.flatnonzero((h >= LEAST_HESSIAN * UNIT) & (whole[1] - h >= LEAST_HESSIAN * UNIT))
        if not len(ok):
            continue
        if len(ok) < len(at):
            at, g, h = at[ok], g[ok], h[ok]
        both = _score((np.concatenate([g, whole[0] - g]), np.concatenate([h, whole[1] - h])), p)
        gain = both[:len(g)] + both[len(g):] - parent
        k = int(gain.argmax())                                     # the first feature and bin of equal gains
        key = (float(gain[k]), -int(at[k]), -side)
        if gain[k] > 1e-12 and key > best:
            best = key
    if len(best) == 1:
        return None
    c, side = -best[1], -best[2]
    f = int(feature[c])
    a = sums[:, start[f]:c + 1].sum(axis=1) + (sums[:, last[f]] if side else 0)
    b = sums[:, start[f]:last[f] + 1].sum(axis=1) - a
    a, b = (v.tolist() if len(v) == 4 else [*v.tolist(), int(v[2]) * int(UNIT)] for v in (a, b))      # without weights a row's is 1
    return best[0], int(features[f]), int(c - start[f]), bool(side), tuple(a), tuple(b)


def _score(sums: np.ndarray, p: Params) -> np.ndarray:
    g, h = np.abs(sums[0]) * (1 / UNIT), sums[1] * (1 / UNIT)
    g = np.maximum(g - p.l1, 0.0)
    return g * g / (h + p.l2)


# ---- the batch


def _taken(part: dict, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """These rows of ``x``; the element keeps them for the rounds that learn from the same rows."""
    old = part.get("taken")
    if old is None or not np.array_equal(old[0], rows):
        own = np.empty((len(rows), x.shape[1]), dtype=x.dtype, order="F")
        for f in range(x.shape[1]):
            own[:, f] = x[:, f].take(rows)
        old = part["taken"] = rows, own
    return old[1]


class _Batch:
    def __init__(self, store: Store, fits: list[Fit], run: int = FEATURE_RUN):
        self.fits = fits
        self.run = run                                                                # features of a histogram
        self.bins = np.array([len(e) + 2 for e in store.edges], dtype=np.int64)       # value bins and "missing"
        self.missing = self.bins - 1
        place = {c: i for i, c in enumerate(store.columns)}
        self.columns = [np.array([place[c] for c in (f.columns if f.columns is not None else store.columns)], dtype=np.int64) for f in fits]

    def features(self, i: int, turn: int) -> np.ndarray:
        """The columns that tree ``turn`` of booster ``i`` may split."""
        own, p = self.columns[i], self.fits[i].params
        if p.features >= 1 or not len(own):
            return own
        rng = np.random.default_rng([p.seed & 0x7FFFFFFF, turn])
        return np.sort(own[rng.permutation(len(own))[:max(1, round(p.features * len(own)))]])

    def level(self, part: dict, asks: dict, turn: int, first: bool, kept: dict | None = None) -> list:
        """Histograms that one element (a block, with some boosters) gives for the nodes to be summed.  ``kept``: where the rows of a
        booster's tree stood at its last level, if somebody keeps it."""
        out = []
        block = part["block"]
        for k, i in enumerate(part["fits"]):
            if i not in asks:
                continue
            fit = self.fits[i]
            p = fit.params
            routes, nodes, features = asks[i][:3]
            margin = part["margin"][:, k]
            ends, place = kept.get(i) if kept else None, None
            if first or ends is None:
                learns = part["role"][:, k] == LEARN
                if p.rows_every and p.rows < 1:
                    learns &= _drawn(block["uid"], p, turn)
                rows = np.flatnonzero(learns)
                ends = {0: rows}
            if not first:
                ends = rows_at(block["x"], self.missing, routes, ends)
                found = [ends.get(n, np.zeros(0, dtype=np.int64)) for n in nodes]
                rows, place = np.concatenate(found), np.repeat(np.arange(len(nodes)), [len(f) for f in found])
            if kept is not None:
                kept[i] = ends
            g, h, w = _gradients(block, margin, fit, rows)
            if first:
                check = np.flatnonzero(part["role"][:, k] == CHECK)
                loss, checked = 0, len(check) * int(UNIT)
                if len(check):
                    m, y = margin[check], block["y"][check]
                    cw = np.rint(block[fit.weight][check] * UNIT) if fit.weight else UNIT
                    checked = int(cw.sum()) if fit.weight else checked
                    if fit.patience:
                        loss = int(np.rint((np.logaddexp(0, m) - y * m) * cw).sum())
                out.append((("sums", i), np.array([int(g.sum()), int(h.sum()), len(rows), len(rows) * int(UNIT) if w is None else int(w.sum()), loss, checked])))
            x, at = (block["x"], rows) if not first or kept is None else (_taken(part, block["x"], rows), None)
            for run in range(0, len(features), self.run):
                f = features[run:run + self.run]
                out.append(((i, run), _histogram(x, at, place, len(nodes), f, self.bins[f], g, h, w)))
        return out

    def whole(self, item, asks: dict, before=None):
        """The histograms of all nodes asked, from those summed and their parents' of the level before."""
        key, hist = item
        if key[0] == "sums" or len(asks[key[0]]) < 4:
            return item
        ways = asks[key[0]][3]
        out = np.empty((len(hist), len(ways), hist.shape[2]), dtype=hist.dtype)
        for n, (at, up) in enumerate(ways):
            if up < 0:
                out[:, n] = hist[:, at]
            else:
                np.subtract(before[:, up], hist[:, at], out=out[:, n])
        return key, out

    def splits(self, item, asks: dict):
        key, hist = item
        if key[0] == "sums":
            return key, hist
        i, run = key
        f = asks[i][2][run:run + self.run]
        return key, _best(hist, f, self.bins[f], self.fits[i].params)

    def stretch(self, part: dict) -> dict:
        """For an element with all rows of its boosters: their next ``CHECKPOINT_ROUNDS`` rounds, by the steps of the driver's loop."""
        part = {**part, "margin": part["margin"].copy(), "course": {}, "grown": {}}
        for k, (i, course) in enumerate(zip(part["fits"], part["courses"])):
            fit, course, grown = self.fits[i], {**course, "losses": list(course["losses"])}, []
            p = fit.params
            one = {"block": part["block"], "fits": [i], "role": part["role"][:, k:k + 1], "margin": part["margin"][:, k:k + 1]}
            while course["going"] and len(grown) < CHECKPOINT_ROUNDS:
                turn = course["turn"]
                features = self.features(i, turn)
                asks = {i: (None, [0], features)}
                kept: dict = {}
                hists, before = dict(self.level(one, asks, turn, True, kept)), [0]
                found = _collected(self.splits(x, asks) for x in hists.items())[i]
                if not _goes_on(course, found["sums"], fit):
                    break
                g = _root(found["sums"], found.get("splits", {}), p)
                while nodes := g.frontier(p):
                    some, ways = g.summed(nodes, before)
                    asks = {i: (g.routes(), some, features, ways)}
                    hists = dict(self.whole(x, asks, hists[x[0]]) for x in self.level(one, asks, turn, False, kept))
                    g.learn(nodes, _collected(self.splits(x, asks) for x in hists.items()).get(i, {}).get("splits", {}), p)
                    before = nodes
                routes = g.valued(p)
                one["margin"][:, 0] += routes["value"][bins_to_nodes(part["block"]["x"], self.missing, routes)]
                grown.append(g.plain())
                _grew(course, g, fit)
            part["course"][i], part["grown"][i] = course, grown
        part["courses"] = [part["course"][i] for i in part["fits"]]
        return part

    def moved(self, part: dict, done: dict) -> dict:
        """The element with its boosters' margins after their last trees."""
        margin = part["margin"].copy()
        for k, i in enumerate(part["fits"]):
            if i in done:
                margin[:, k] += done[i]["value"][bins_to_nodes(part["block"]["x"], self.missing, done[i])]
        return {**part, "margin": margin}


def _course(fit: Fit) -> dict:
    """How far a booster has come: its rounds, its losses and the least of them, whether it goes on."""
    return {"turn": 0, "losses": [], "least": (math.inf, 0), "going": fit.params.rounds > 0}


def _goes_on(course: dict, sums: tuple, fit: Fit) -> bool:
    """Whether another tree is grown, after the sums of a round's first step."""
    turn = course["turn"]
    if fit.patience and sums[5]:
        loss = sums[4] / sums[5]
        course["losses"].append(loss)
        if turn and loss < course["least"][0]:               # one round is kept at least
            course["least"] = (loss, turn)
        elif turn - course["least"][1] >= fit.patience:
            course["going"] = False
    if turn >= fit.params.rounds:
        course["going"] = False
    return course["going"]


def _grew(course: dict, g: _Growing, fit: Fit) -> None:
    """After a round's tree."""
    p = fit.params
    course["turn"] += 1
    # a booster that splits nothing now never will (with all rows and features), or waits for another draw of them
    if not g.taken and p.features >= 1 and not (p.rows_every and p.rows < 1):
        course["going"] = False
    # without patience nothing is learned from one more job after the last round
    if course["turn"] >= p.rounds and not fit.patience:
        course["going"] = False


def _root(sums: tuple, splits: dict, p: Params) -> _Growing:
    """A tree of one node whose best split is known."""
    g = _Growing()
    g.add(sums[:4], 0)
    g.asked = 1
    g.split[0] = splits.get(0) if p.depth > 0 else None
    g.choose(p)
    return g


def _collected(found) -> dict:
    """Per booster: its sums, if among the answers, and the best split of every node over the runs of features."""
    out: dict = {}
    for key, value in found:
        if key[0] == "sums":
            out.setdefault(key[1], {})["sums"] = tuple(int(v) for v in value)
        else:
            best = out.setdefault(key[0], {}).setdefault("splits", {})
            for n, fields in enumerate(value):
                s = _Split(*fields) if fields else None
                if s and (n not in best or s.order() < best[n].order()):
                    best[n] = s
    return out


def _of(shared) -> _Batch:
    """The broadcast batch: bytes, so that executors need no copy of this package; unpacked once per worker process, as batches may run side by side."""
    token, data = shared.value
    kept = sys.modules.setdefault("_boost_batches", types.ModuleType("_boost_batches")).__dict__.setdefault("batches", {})
    if token not in kept:
        while len(kept) >= BATCHES:
            kept.pop(next(iter(kept)))
        kept[token] = cloudpickle.loads(data)
    return kept[token]


def _ask(data, shared, asks: dict, turn: int, before, parts: int) -> tuple[dict, object]:
    """Per booster: the best split of every node asked (and the root's sums in a tree's first job); and the kept histograms, which the
    next level takes as ``before`` (None: a tree's first job).  ``shared``: the broadcast batch."""
    first = before is None
    summed = data.flatMap(lambda part: _of(shared).level(part, asks, turn, first)).reduceByKey(lambda a, b: a + b, parts)
    if not first:                                            # dealt alike, so nothing is shuffled here
        summed = before.join(summed, parts).map(lambda x: _of(shared).whole((x[0], x[1][1]), asks, x[1][0]), preservesPartitioning=True)
    summed = summed.persist(StorageLevel.MEMORY_AND_DISK)
    found = summed.map(lambda x: _of(shared).splits(x, asks)).collect()
    if not first:
        before.unpersist()
    return _collected(found), summed


def _drop_checkpoint(sc, rdd) -> None:
    path = rdd.getCheckpointFile() if rdd is not None else None
    if path:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def fit_batch(store: Store, fits: list[Fit]) -> list[BoostedTrees]:
    """Fit all boosters of a batch, in step.  One Spark job per level of a round's trees, whatever their number."""
    if not fits:
        return []
    spark_context = store.blocks.context
    from pyspark.sql import SparkSession
    ensure_checkpoint_dir(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    base, learning = _base_rates(store, fits)
    blocks = max(1, store.blocks.count())
    one_block = blocks == 1
    batch = _Batch(store, fits, ALONE_RUN if one_block else FEATURE_RUN)
    shared = spark_context.broadcast((uuid.uuid4().hex, cloudpickle.dumps(batch)))
    # few blocks: cores share the boosters
    groups = max(1, min(len(fits), 2 * spark_context.defaultParallelism if one_block else -(-spark_context.defaultParallelism // blocks)))
    dealt = _dealt([n * f.params.rounds * len(c) for n, f, c in zip(learning, fits, batch.columns)], groups)
    courses = [_course(f) for f in fits]

    def start(block):
        for group, mine in enumerate(dealt):
            role = np.stack([roles(block, fits[i].learn, fits[i].check) for i in mine], axis=1)
            yield {"block": block, "group": group, "fits": mine, "role": role, "margin": np.tile(np.array([base[i] for i in mine]), (len(block["y"]), 1)),
                   "courses": [courses[i] for i in mine]}

    data = store.blocks.flatMap(start)
    if groups > 1:
        data = data.map(lambda e: (e["group"] if one_block else int(e["block"]["uid"][0] >> np.uint64(33)) + e["group"], e)).partitionBy(
            groups * blocks, lambda k: k).values()
    models = [BoostedTrees(list(store.columns), base[i]) for i in range(len(fits))]
    if store.count:
        (_alone if one_block else _in_step)(spark_context, batch, shared, data.persist(StorageLevel.MEMORY_AND_DISK), models, courses, store.edges)
    shared.destroy()
    for i, m in enumerate(models):
        m.losses.extend(courses[i]["losses"])
        if m.losses:
            m.trees = m.trees[:courses[i]["least"][1]]
        _narrow(m, fits[i].columns)
    return models


def _dealt(loads: list[float], groups: int) -> list[list[int]]:
    """Boosters dealt to groups of about the same load: the heaviest first, each to the lightest group."""
    heap, out = [(0.0, 0, g) for g in range(groups)], [[] for _ in range(groups)]
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, n, g = heappop(heap)
        out[g].append(i)
        heappush(heap, (load + loads[i], n + 1, g))
    return out


def _alone(context, batch: _Batch, shared, data, models: list[BoostedTrees], courses: list[dict], edges: list) -> None:
    """Boosters whose rows are one block: elements exchange nothing, so a job runs ``CHECKPOINT_ROUNDS`` rounds of each."""
    kept = None
    while any(c["going"] for c in courses):
        before, data = data, data.map(lambda part: _of(shared).stretch(part)).persist(StorageLevel.MEMORY_AND_DISK)
        data.checkpoint()
        for course, grown in data.map(lambda part: (part["course"], part["grown"])).collect():
            for i, trees in grown.items():
                courses[i] = course[i]
                models[i].trees.extend(_Growing.of(t).finish(batch.fits[i].params, edges)[0] for t in trees)
        before.unpersist()
        _drop_checkpoint(context, kept)
        kept = data
    data.unpersist()
    _drop_checkpoint(context, kept)


def _in_step(context, batch: _Batch, shared, data, models: list[BoostedTrees], courses: list[dict], edges: list) -> None:
    """Boosters over many blocks: one job per level of a round's trees."""
    fits = batch.fits
    kept = before = None
    done: dict = {}
    turn = 0
    runs = -(-max(len(c) for c in batch.columns) // FEATURE_RUN)
    parts = max(1, min(len(fits) * runs, data.getNumPartitions(), 2 * context.defaultParallelism))
    while active := [i for i, c in enumerate(courses) if c["going"]]:
        if turn:
            before, data = data, data.map(lambda part, done=done: _of(shared).moved(part, done)).persist(StorageLevel.MEMORY_AND_DISK)
            if turn % CHECKPOINT_ROUNDS == 0:
                data.checkpoint()
        features = {i: batch.features(i, turn) for i in active}
        # this job also makes and keeps the margins of the round
        found, hists = _ask(data, shared, {i: (None, [0], features[i]) for i in active}, turn, None, parts)
        if before is not None:
            before.unpersist()
            before = None
            if turn % CHECKPOINT_ROUNDS == 0:
                _drop_checkpoint(context, kept)
                kept = data
        growing: dict[int, _Growing] = {}
        asked = {i: [0] for i in active}
        for i in active:
            sums = found.get(i, {}).get("sums", (0,) * 6)
            if _goes_on(courses[i], sums, fits[i]):
                growing[i] = _root(sums, found.get(i, {}).get("splits", {}), fits[i].params)
        while True:
            asks = {}
            for i, g in growing.items():
                nodes = g.frontier(fits[i].params)
                if nodes:
                    some, ways = g.summed(nodes, asked[i])
                    asks[i] = (g.routes(), some, features[i], ways)
                    asked[i] = nodes
            if not asks:
                break
            answers, hists = _ask(data, shared, asks, turn, hists, parts)
            for i in asks:
                growing[i].learn(asked[i], answers.get(i, {}).get("splits", {}), fits[i].params)
        hists.unpersist()
        done = {}
        for i, g in growing.items():
            tree, routes = g.finish(fits[i].params, edges)
            models[i].trees.append(tree)
            done[i] = routes
            _grew(courses[i], g, fits[i])
        turn += 1
    data.unpersist()
    _drop_checkpoint(context, kept)


def _narrow(m: BoostedTrees, columns: list[str] | None) -> None:
    """Node features as places among the booster's own columns."""
    if columns is None:
        return
    place = {c: i for i, c in enumerate(columns)}
    to = np.array([place.get(c, -1) for c in m.columns] + [-1])
    for t in m.trees:
        t.feature = to[t.feature]
    m.columns = list(columns)


def _base_rates(store: Store, fits: list[Fit]) -> tuple[list[float], list[float]]:
    """Log-odds of label 1 among the rows that a booster learns from, and the weight of these rows."""
    def sums(block):
        out = np.zeros((len(fits), 2), dtype=np.int64)
        for i, f in enumerate(fits):
            w = np.rint((block[f.weight] if f.weight else np.ones(len(block["y"]))) * UNIT) * (roles(block, f.learn, f.check) == LEARN)
            out[i] = int(w.sum()), int(np.rint(w * block["y"]).sum())
        return out

    total = store.blocks.map(sums).fold(np.zeros((len(fits), 2), dtype=np.int64), lambda a, b: a + b)
    rate = [min(max(one / all_, 1e-6), 1 - 1e-6) if all_ else 0.5 for all_, one in total.tolist()]
    return [math.log(r / (1 - r)) for r in rate], [all_ / UNIT for all_, _ in total.tolist()]
