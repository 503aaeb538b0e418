"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import join_groups, materialize


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One star step on (a, b), a > b: neighbours of each node move to the smallest of them."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")))
    joined = join_groups(both, least, ["u"], "size", max(1, total)).withColumn("m", F.least("m", "u"))
    moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return materialize(moved.where("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node that has a link; root is the smallest node of its component.

    Nodes are longs; null ends and loops are left out, repeated links count once. All steps are shuffles:
    only counts reach the driver.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    while n:
        edges = _star(_star(edges, 2 * n, True), n, False)
        n = edges.count()
        # done when all are stars: each node hangs on one root, which hangs on none
        heads = edges.groupBy("a").agg(F.count("*").alias("n"))
        if not heads.where("n > 1").limit(1).count() and not edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi").limit(1).count():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
