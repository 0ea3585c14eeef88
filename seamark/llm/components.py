"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.session import write_out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller ones as well. Each step is one
    grouping for the smallest neighbour, which Spark combines before shuffling, and
    one join back, so a hub is never gathered in one place. The number of rounds
    grows with the logarithm of the longest path. Each round is written to the
    shared folder, which ends its lineage.
    """
    now = write_out(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large step: of each node, the larger neighbours are tied to the smallest of all, itself included.
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small step: of each node, the smaller neighbours and itself are tied to the smallest one.
        large = write_out(large.distinct(), "edges")
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(lows, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(lows.select("a", F.col("low").alias("b")))
        after = write_out(small.where("a <> b").distinct(), "edges")
        if not after.join(now, ["a", "b"], "left_anti").limit(1).count() and after.count() == now.count():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                after.select("b", "b").distinct()
            )
        now = after
