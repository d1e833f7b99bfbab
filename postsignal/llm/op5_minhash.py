"""MinHash near-duplicates: fast similarity sketches, banding, exact verification.

1. Every whole text becomes its set of 5-word shingle hashes, the set's 128-bit
   identity and one hash per band of its sketch (``similarity``), in Arrow
   batches.  Texts with equal sets are one class, stood for by its smallest id.
2. Class representatives meet in band buckets.  A bucket gives only the edges
   from its smallest id to the others (linear, never its pairs); connected
   components of these edges are candidate clusters, and any two texts that
   share a bucket are in the same cluster.
3. A cluster is dealt into blocks of bounded rows and shingles, and every pair of
   blocks is one group: pairs that share a band and whose sketches do not rule the
   similarity out are confirmed on the full sets, likeliest first, skipping
   pairs already connected.  Only confirmed links leave the task, fewer than
   the rows of its two blocks.
4. Components of the links, carried to all members of the classes.

No cap drops a bucket, a cluster or a partner.  The chance that two texts of
similarity ``s`` share no band is ``(1 - s**rows)**bands``: 2.5e-7 at 0.75 with
40 bands of 4.  The sketch screen stands five standard deviations below the
threshold.

Defined cases: null or word-less texts have an empty set and are linked with
nothing; rows without an id are linked with nothing and keep a null component;
repeated ids are one node; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .graph import connected_components
from .similarity import bands, set_keys, sketches
from .textkit import Words, chunks, shingle_sets, utf8


@dataclass(frozen=True)
class MinHashParams:
    words: int = 5                 # words of a shingle
    percent: int = 75              # links have 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 4                  # coordinates of a band
    block_rows: int = 512          # of a cluster's block
    block_shingles: int = 1 << 20

    @property
    def size(self) -> int:
        return self.bands * self.rows


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signatures(p: MinHashParams):
    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in chunks(off):
                flat, ends = shingle_sets(Words(buf[off[i]:off[j]], off[i:j + 1] - off[i]), p.words)
                band = _signed(bands(sketches(flat, ends, p.size), p.rows)).reshape(-1)
                key = _signed(set_keys(flat, ends))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(ends)), pa.array(key[:, 0]), pa.array(key[:, 1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * p.bands, p.bands, dtype=np.int32)), pa.array(band)),
                ], names=["id", "n", "lo", "hi", "bands"])
    return run


def _sets(p: MinHashParams):
    def run(batches):
        for batch in batches:
            rest = [batch.column(k) for k in range(1, batch.num_columns)]
            buf, off = utf8(batch.column(0))
            for i, j in chunks(off):
                flat, ends = shingle_sets(Words(buf[off[i]:off[j]], off[i:j + 1] - off[i]), p.words)
                cells = pa.array([flat[ends[d]:ends[d + 1]].tobytes() for d in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([cells, *(c.slice(i, j - i) for c in rest)], names=["shingles", *batch.schema.names[1:]])
    return run


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _links(p: MinHashParams):
    """Confirmed links of one pair of blocks (``x``, ``y``; equal: inside a block), at most a spanning forest."""
    least = p.percent / 100 - 5 * math.sqrt(p.percent / 100 * (1 - p.percent / 100) / p.size)

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.lexsort((np.arange(len(ids)), ids))
        ids = ids[order]
        sets = [np.frombuffer(table["shingles"][int(k)].as_py(), dtype=np.uint64) for k in order]
        same_block = table["x"][0].as_py() == table["y"][0].as_py()
        side = table["side"].to_numpy()[order]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        sketch = sketches(np.concatenate(sets), ends, p.size)
        band = bands(sketch, p.rows)
        small = (sketch & np.uint64(0xFFFF)).astype(np.uint16)
        size = np.diff(ends)
        found = []
        for r in range(len(ids) - 1):
            rest = slice(r + 1, len(ids))
            ok = (band[rest] == band[r]).any(axis=1)
            if not same_block:
                ok &= side[rest] != side[r]
            at = np.flatnonzero(ok) + r + 1
            at = at[(100 * np.minimum(size[at], size[r]) >= p.percent * np.maximum(size[at], size[r])) & (ids[at] != ids[r])]
            if len(at):
                alike = (small[at] == small[r]).sum(axis=1)
                keep = alike >= least * p.size
                found += [(-int(s), r, int(k)) for s, k in zip(alike[keep], at[keep])]
        parent = np.arange(len(ids))
        for k in range(1, len(ids)):
            if ids[k] == ids[k - 1]:
                parent[k] = _find(parent, k - 1)
        a, b = [], []
        for _, r, k in sorted(found):
            x, y = _find(parent, r), _find(parent, k)
            if x == y:
                continue
            both = len(np.intersect1d(sets[r], sets[k], assume_unique=True))
            if 100 * both >= p.percent * (len(sets[r]) + len(sets[k]) - both):
                parent[max(x, y)] = min(x, y)
                a.append(int(ids[r]))
                b.append(int(ids[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    params: MinHashParams = MinHashParams()) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id``, ``kept`` (see the module)."""
    p = params
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = texts.mapInArrow(_signatures(p), "id long, n long, lo long, hi long, bands array<long>").checkpoint()

    linkable = signed.filter("n > 0 and id is not null")
    classes = linkable.groupBy("lo", "hi").agg(F.min("id").alias("rep"))
    reps = linkable.join(classes.select(F.col("rep").alias("id"), "lo", "hi"), ["id", "lo", "hi"], "left_semi")
    entries = reps.select("id", F.explode("bands").alias("key"))
    pivots = entries.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).filter("pivot < most").drop("most")
    stars = entries.join(pivots, "key").filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))

    cluster = connected_components(stars)
    member = cluster.join(reps.select(F.col("id").alias("node"), "n"), "node")
    blocks = member.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / p.block_rows), F.ceil(F.sum("n") / p.block_shingles)).cast("int").alias("blocks"))
    placed = (member.select("node", "component").distinct().join(blocks, "component")
              .select(F.col("node").alias("id"), "component", "blocks", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("mine")))
    of_members = (texts.join(placed, "id").select("text", "id", "component", "blocks", "mine")
                  .mapInArrow(_sets(p), "shingles binary, id long, component long, blocks int, mine int")
                  .filter("length(shingles) > 0"))
    paired = (of_members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
              .select("component", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
                      F.col("mine").alias("side"), "id", "shingles"))
    links = paired.groupBy("component", "x", "y").applyInArrow(_links(p), "a long, b long")

    joined = connected_components(links)
    return (signed.select("id", "n", "lo", "hi").join(classes, ["lo", "hi"], "left")
            .withColumn("rep", F.when(F.col("n") > 0, F.col("rep")))
            .withColumn("own", F.coalesce(F.when(F.col("id").isNotNull(), F.col("rep")), F.col("id")))
            .join(joined.select(F.col("node").alias("own"), "component"), "own", "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "own").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         params: MinHashParams = MinHashParams()) -> DataFrame:
    """``docs`` without the rows whose component is represented by a smaller id; columns unchanged."""
    name = "gone"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    gone = near_duplicates(docs, id_col, text_col, params).filter("not kept").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
