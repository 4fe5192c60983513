"""Connected components of large sparse graphs by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (bigint): the smallest node reachable.

    Every round hangs each node's larger neighbours, then its smaller ones, under its
    smallest neighbour; the number of rounds grows with the logarithm of the longest
    path. Minima combine before the shuffle, and the joins split uneven nodes.
    """
    found = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = _state(found)
    for _ in range(most_rounds):
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours go under the smallest of the neighbours and the node itself.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node go under the smallest neighbour.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        under = large.join(low, "a")
        small = under.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = stored(small.where("a != b").distinct(), "edges")
        discard(found)
        found, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    stars = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
