"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordered import Scratch


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end; loops go."""
    ends = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node but
    the smallest of each component.

    ``edges`` has columns ``a`` and ``b``; loops, repeats and edges with a null end
    say nothing.  Every round hangs the larger neighbours of a node below its
    smallest neighbour, then its smaller ones; both are minima that combine before
    the shuffle, and the table of the round before is deleted.  The rounds end when
    nothing changes; not to end is an error."""
    held = Scratch(edges.sparkSession)
    edges, was = held.write(_down(edges)), None
    for _ in range(rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("sum")).first()
        if now == was or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        was = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = _down(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = Scratch(edges.sparkSession)
        edges = after.write(_down(small.unionByName(least.select("a", F.col("m").alias("b")))))
        held.clear()
        held = after
    raise RuntimeError(f"components still change after {rounds} rounds")
