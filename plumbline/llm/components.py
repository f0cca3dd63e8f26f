"""Connected components of a graph given as a DataFrame of edges.

Alternating large-star and small-star steps (Kiveris et al., 2014): each is an
aggregation by node, combined before the shuffle, and an equi-join; no node's
neighbours are ever collected.  The join has a second key, a few salts, so that it does
not share the aggregation's exchange and Spark can split a node with a large share of the
edges.  The steps end when the edges are stars around the least node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


#: A node's edges are joined to it by so many keys.
SALTS = 4


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _joined(edges: DataFrame, least: DataFrame, node: str, other: str) -> DataFrame:
    """``edges`` with their node's ``m`` of ``least``."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted, [node, "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node among its neighbours and itself."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _joined(both, least, "a", "b").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("x"))
    least = down.groupBy("n").agg(F.min("x").alias("m"))
    linked = _joined(down, least, "n", "x").select(F.col("m").alias("a"), F.col("x").alias("b")).where("a <> b")
    return linked.unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of every node on an edge (``a``, ``b``).

    Nodes must not be null; edges may repeat and may loop.  No edges give no rows.
    """
    state = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if not mark[0] or tuple(mark) == seen:
            break
        seen = tuple(mark)
        state = written(_small_star(_large_star(state)), "edges")
    return state.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
