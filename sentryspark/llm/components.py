"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, ``root`` being its component's smallest node.

    ``edges`` has bigint columns ``a`` and ``b``. Alternates large-star and small-star steps: each
    node passes its smallest neighbour to its larger, then to its smaller neighbours. Minima are
    combined before the shuffle, so a hub costs no single task; every round is written to the
    shared folder and rounds grow with the logarithm of the nodes. Nulls and self-loops are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    current = written(
        edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    state = None
    while True:
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if now == state or not now[0]:
            break
        state = now
        current = written(_small_star(_large_star(current)), "edges")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(current.select("b", "b").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(
        F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()
