"""Connected components by alternating large and small stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpairs.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its least node) of all nodes of edges (a, b), of any type that has an order.

    Each round replaces a node's edges by edges to the least node it sees; rounds are about the logarithm of
    the longest path. A hub's edges are joined with one aggregated row, never gathered; every round is a
    table in the shared folder, so lost executors cost one round at most.
    """

    def stars(edges: DataFrame, small: bool) -> DataFrame:
        # b <= a throughout: small stars look at a's smaller neighbours, large stars at all of them
        sides = edges if small else edges.union(edges.select(F.col("b"), F.col("a")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        out = sides.filter(F.col("a") != F.col("b")).join(least, "a")
        if small:
            out = out.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        else:
            out = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        return out.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = written(edges, "edges"), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            break
        last = state
        before, edges = edges, written(stars(stars(edges, small=False), small=True), "edges")
        discard(before)
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(edges.select("b", "b")).distinct()
