"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Each half-round is one minimum per node and one join; minima are combined before the shuffle, and the joins
are plain sort-merge joins, so a node with very many edges is split by adaptive execution. Every round is
written to the shared checkpoint folder. The rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampline.session import pinned


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (large) or the smaller and equal (small) neighbours of each node to its minimum."""
    if large:
        links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = pinned(links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
    tied = links.join(low, "a")
    if large:
        tied = tied.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b")))
    return tied.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """`node`, `root` (the smallest node it reaches) for every node with an edge to another one.

    Loops, repeated edges and both directions are allowed; null ends are left out; no edges, no rows.
    """
    edges = pinned(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(max_rounds):
        edges = pinned(_star(pinned(_star(edges, True)), False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
