"""Connected components by alternating large and small stars, all in DataFrames.

Each round rewires every edge towards the smallest neighbour; it ends when a round changes nothing. Rounds grow with
the logarithm of the longest chain. Links stay in Spark: each round is written to the shared folder, so a lost
executor costs that round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # a < b on every edge: b's smaller neighbours meet at the smallest of them.
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    up = joined.select(F.col("m").alias("a"), F.col("b"))
    down = joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return up.unionByName(down).where("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root) for every node of an edge; root is the component's smallest node."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    while before[0]:
        last, edges = edges, written(_small_star(_large_star(edges)), "edges")
        delete(edges.sparkSession, [last.scratch_path])
        after = _state(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
