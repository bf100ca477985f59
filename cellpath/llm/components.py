"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpath.llm.staged import stage


def _pull(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of every node to the smallest node around it.

    With ``larger_only`` only larger neighbours move (large star), else only smaller ones (small star).
    The minimum is combined before it moves; the join on a node with many neighbours can be split.
    """
    if larger_only:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = around.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        return moved.where("a < b").distinct()
    down = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # larger to smaller
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    moved = joined.select(F.col("m").alias("x"), F.col("b").alias("y")).union(least.select(F.col("m").alias("x"), F.col("a").alias("y")))
    return moved.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)``; the component is its smallest node.

    Stars end up with one centre each, after a number of rounds that grows with the logarithm of
    the number of nodes. Loops and repeated edges do no harm.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = stage(now, "components", small=True)
    mark = None
    while True:
        # done when every node hangs on one centre and no centre hangs on another
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        mark = state
        now = stage(_pull(_pull(now, True), False), "components", small=True)
