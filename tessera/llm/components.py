"""Connected components of a large edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: Edges of a node, of two numbers each, above which they aren't brought to one task.
HUB = 5_000_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Each round ends in a table of the shared folder, so a lost executor costs one round at most. Smallest neighbours are aggregated
    where the edges are, and the edges of a node that has very many meet its smallest neighbour where they are.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, edges_now = None, now.count()

    def joined(rows: DataFrame, facts: DataFrame, most: int) -> DataFrame:
        """Where there are no more than HUB edges in all, no node is a hub."""
        return rows.join(facts, "a") if most <= HUB else spread_join(rows, written(facts, "stars"), "a", "n", HUB)

    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: each larger neighbour of a node goes to the node's smallest neighbour
        large = joined(both.where("b > a"), least, edges_now).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large if 2 * edges_now <= HUB else written(large, "edges")
        # small star: each smaller neighbour, and the node itself, go to the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined(large, low, 2 * edges_now).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(small, "edges")
        edges_now = now.count()
        state = (edges_now, now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()[0])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
