"""Connected components of an edge table as a short series of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtrail.session import materialize


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; another set gives another mark but for a chance of 2**-64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head())


def connected(edges: DataFrame) -> DataFrame:
    """(member, component) for every vertex of edges (a, b); the component is its smallest vertex.

    Large-star and small-star steps in turn: each vertex sends its larger (then
    its smaller) neighbours to the smallest vertex it knows. Every step writes its
    edges to the shared folder, so no lineage grows and lost executors do no harm.
    The loop ends when both steps leave the edges as they are; the number of
    rounds grows with the logarithm of the longest path.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # vertices that are the smallest they know keep nothing of their own: their edges come from the other end
        large = materialize(large.where("a <> b").distinct(), "large")
        small_low = large.groupBy("a").agg(F.min("b").alias("low"))
        pairs = large.join(small_low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small_low.select("a", F.col("low").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "small")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("member"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("member"), F.col("b").alias("component")).distinct()
    )
