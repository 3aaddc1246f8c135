"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import checkpointed, join_spread


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands its smallest neighbour to its other neighbours.

    `edges` has columns u, v. The minimum is combined before the shuffle and joined back with the edges
    of a hub spread over many tasks.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = join_spread(seen, least, "u", "v")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); component is the smallest node reachable.

    Each round is checkpointed in the shared folder. It ends when a round changes no edge, after
    a number of rounds that grows with the logarithm of the longest chain.
    """
    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # One row: how many edges there are, and an order-free digest of them.
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = digest(now)
    while seen[0]:
        now = checkpointed(_star(_star(now, large=True), large=False))
        after = digest(now)
        if after == seen:
            break
        seen = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
