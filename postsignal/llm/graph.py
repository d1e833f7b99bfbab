"""Connected components of an edge table, by alternating star contraction.

Large-star joins every larger neighbour of a node to the node's smallest
neighbour; small-star does it for the smaller neighbours.  After O(log n)
rounds every component is a star around its smallest id.  Edges stay
distributed; every step is one aggregate and one join (a centre with very many
edges is pre-aggregated map-side, its join side is split by adaptive execution)
and its result is a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (two long columns ``a``, ``b``); component: the smallest node.

    Repeated edges, both directions and self loops are allowed; a self loop
    alone gives no node.  Empty edges give an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    before = _state(e)
    while before[0]:
        e = _small(_large(e)).checkpoint()
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
