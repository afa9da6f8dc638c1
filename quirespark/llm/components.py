"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import staged


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node passes the least of its neighbourhood to its larger (large star)
    or other smaller neighbours (small star). The least is aggregated on the map
    side and joined from a staged table, so AQE splits a node with many edges."""
    near = edges.union(edges.select("b", "a")).toDF("a", "b") if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(near.groupBy("a").agg(F.min("b").alias("m")), "star-least").withColumnRenamed("a", "_a")
    both = near.join(least.hint("merge"), near["a"] == least["_a"])
    if large:
        out = both.where("b > a").select("b", F.least("a", "m").alias("m"))
    else:
        out = both.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b"), "m")
    return staged(out.where("b != m").toDF("a", "b").distinct(), "star-edges")


def print_of(edges: DataFrame):
    """Count and order-free sum of the edges: equal for two rounds only when nothing moved."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component), for every node with an edge.

    ``edges``: columns a, b of one ordered type. Ends as soon as a pair of rounds
    changes nothing; then every edge leads to its root. The number of rounds grows
    with the logarithm of the longest path.
    """
    edges = staged(edges.select("a", "b").where("a != b").distinct(), "edges")
    seen = None
    while (now := print_of(edges)) != seen:
        seen = now
        if not now[0]:
            break
        edges = star(star(edges, True), False)
    leaves = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return leaves.union(leaves.select("root", "root")).distinct().toDF("node", "root")
