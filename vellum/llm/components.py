"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) joined back to the
edges; a node with very many neighbours only makes one side of that join skewed,
which adaptive execution splits.  Each round is written to the shared folder and the one
before it removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.store import remove, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges(a, b)``.

    Loops and repeated edges are allowed; nodes without an edge do not occur.  An
    empty edge table gives an empty result.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        old, edges = edges, written(_small_star(_large_star(edges)), "edges")
        remove(old)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
