"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import frozen


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """Link neighbours of each node to its smallest neighbour."""
    if keep_larger:
        pairs = pairs.union(pairs.select("v", "u")).toDF("u", "v")
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if keep_larger:
        smallest = smallest.withColumn("m", F.least("u", "m"))
    joined = pairs.join(smallest, "u")
    if keep_larger:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(smallest.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of ``links``; the component is the
    smallest node that can be reached.

    Links may repeat and may join a node with itself; those with a NULL end
    are no links. Each round is written to the shared scratch folder; rounds
    grow with the logarithm of the longest chain. No node's links are brought
    together in one task: minima are combined before the shuffle and the join
    that follows may be split by the adaptive planner.
    """
    pairs = links.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    pairs = frozen(pairs.distinct(), "links")
    while True:
        inner = pairs.join(pairs.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = pairs.groupBy("u").count().filter("count > 1")
        if inner.isEmpty() and several.isEmpty():
            break  # every node has one neighbour, a root
        pairs = frozen(_star(_star(pairs, True), False), "links")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))
