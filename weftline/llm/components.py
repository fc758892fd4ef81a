"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b) that isn't the least of its component.

    Each round settles its edges in the shared folder, so that no lineage
    builds up; it ends when a round changes nothing. Edges from a node to
    itself count for nothing. Raises if it hasn't ended after `most_rounds`,
    which is far more than the square of the logarithm of any real input.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    was = _state(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        now = settle(_small_star(_large_star(now)))
        if (state := _state(now)) == was:
            break
        was = state
    else:
        raise RuntimeError("components haven't converged")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
