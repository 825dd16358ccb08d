"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmark.llm.store import discard, settle


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours, tied to its least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's lesser neighbours, tied to its least one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """node, component (the least node that can be reached): a row for each node with an edge.

    edges: a, b long. Each round is two joins and two partial aggregates and is written out;
    the number of rounds grows with the logarithm of the longest path. After most_rounds the
    search may end early: nodes of one component are then still connected, but a node's
    component need not be the whole of what it can reach.
    """
    edges = settle(edges.select("a", "b").filter("a != b").distinct(), "edges")
    stamp, rounds = _stamp(edges), 0
    while stamp[0] and (most_rounds is None or rounds < most_rounds):
        before, edges = edges, settle(_small_star(_large_star(edges)), "edges")
        discard(before)
        last, stamp, rounds = stamp, _stamp(edges), rounds + 1
        if last == stamp:
            break
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    both = down.unionByName(down.select(F.col("component").alias("node"), "component"))
    return both.groupBy("node").agg(F.min("component").alias("component"))
