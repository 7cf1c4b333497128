"""Connected components of a table of edges by alternating star contractions; nothing of it is gathered on the driver but two sums per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a, b) long. Returns (node, root) for each node that has an edge: root is the smallest node that can be reached.

    Each round hangs every larger neighbour of a node on the smallest one (large star), then every smaller neighbour (small star); the rounds end
    when the edges stay the same. Minima are summed up map-side; the joins are plain ones that adaptive execution may split where a node is hot.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = None
    for _ in range(rounds):
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = edges.join(least, F.col("b") == F.col("node")).select("a", F.col("least").alias("b")).distinct()
        large = written(large, "large")
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        small = large.join(least, F.col("a") == F.col("node"))
        small = small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("node", "least"))
        old, edges = edges, written(small.distinct(), "edges")
        released(old, large)
        now = _tally(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b")).distinct()
