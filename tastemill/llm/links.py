"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node that can be reached, for every node of the ``a``-``b`` edges.

    Alternates the large-star and small-star steps, which end in one star per component after a number of rounds that
    grows with the logarithm of its size. Minima combine before the shuffle, so a node with very many edges is no single
    task's work, and every round is a stored table.
    """
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small step: every node with its smaller neighbours (the edge is stored under the larger end).
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()
        edges = checkpointed(small)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum, to see whether a round changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
