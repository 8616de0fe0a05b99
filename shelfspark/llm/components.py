"""Connected components of an edge list, as Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``edges`` (a, b: long).

    Alternates large-star (each node hands its larger neighbours to its
    smallest neighbour) and small-star (its smaller ones) until nothing
    changes; the number of rounds is logarithmic in practice. A round is two
    aggregations and joins by node. Every node takes the minimum of its neighbourhood by a partial
    aggregate, so a hub costs one row per task, and the join that hands the
    minimum back is one that AQE splits when skewed.
    """
    state = written(edges.where("a != b").select("a", "b"), "components")
    while True:
        # Large star: every neighbour larger than u links to the least of u's neighbourhood.
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "components")
        # Small star: u and its smaller neighbours link to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        after = written(small, "components")
        changed = not after.exceptAll(state).isEmpty() or after.count() != state.count()
        drop_written(large)
        drop_written(state)
        state = after
        if not changed:
            break
    leaves = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return leaves.unionByName(roots)
