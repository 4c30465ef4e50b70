"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b); equal roots mean one component.

    Each round, every node takes the neighbour (or itself) of the smallest random priority as
    its parent, and the edges are rewritten between parents. Random priorities shrink chains,
    too, so the number of rounds grows with the logarithm of the longest path. Only minima are
    kept per node, so a hub is summed up before it is shuffled. Each round is written, so no
    lineage builds up.
    """
    left = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    levels: list[DataFrame] = []
    while left.take(1):
        priority = lambda c, n=len(levels): F.xxhash64(F.col(c), F.lit(n))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(priority("b").alias("p"), F.col("b"))).alias("best"))
        parent = F.when(F.col("best.p") < priority("a"), F.col("best.b")).otherwise(F.col("a"))
        parents = materialize(best.select(F.col("a").alias("node"), parent.alias("parent")), "parents")
        levels.append(parents)
        of = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"of_{c}"))  # noqa: E731, B023
        left = materialize(
            left.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b").distinct(),
            "edges",
        )
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = levels[-1].select("node", F.col("parent").alias("root"))
    for parents in reversed(levels[:-1]):
        above = roots.select(F.col("node").alias("parent"), "root")
        roots = parents.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots
