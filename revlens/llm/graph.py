"""Connected components over an edge table, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.store import stored


def _is_star(e: DataFrame) -> bool:
    """Every node has one parent and no parent is a child: nothing is left to do."""
    twice = e.groupBy("u").count().filter("count > 1").limit(1)
    chained = e.select(F.col("v").alias("p")).join(e.select("u"), F.col("p") == F.col("u"), "left_semi").limit(1)
    return twice.isEmpty() and chained.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for each node u that isn't the smallest of its component v.

    Alternating large-star and small-star rounds: a round replaces a node's
    neighbours by the smallest of them. Only minima are aggregated, so a hub
    is pre-aggregated in each task and never gathered. Each round is stored in
    the shared folder; the number of rounds grows with the logarithm of the
    largest component.
    """
    e = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_star(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(least, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(least.select("u", F.col("low").alias("v"))))
        e = stored(small.distinct(), "edges")
    return e
