"""Connected components of a large graph by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import discard, materialise


def _least(edges: DataFrame) -> DataFrame:
    """Per node the least of itself and its neighbours in (node, other), as a table of its own: a join with it stands alone, so a hub can be split."""
    return materialise(edges.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low")), "least")


def _round(edges: DataFrame) -> DataFrame:
    """Large star, then small star, as a written table; what it needed on the way is deleted."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    low = _least(both)
    large = materialise(both.join(low, "node").filter("other > node").select(F.col("other").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct(), "edges")
    down = large.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = _least(down)
    small = down.join(least, "node").filter("other <> low").select(F.col("other").alias("a"), F.col("low").alias("b")).union(least.select("node", "low"))
    out = materialise(small.filter("a <> b").distinct(), "edges")
    discard(low, large, least)
    return out


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node reachable.

    Every round ends in a written table, so neither plans nor lost executors make it repeat earlier
    rounds; the number of rounds grows with the logarithm of the longest chain. An edge of a node to
    itself is ignored; no edges give no rows.
    """
    now = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most):
        then = now
        now = _round(then)
        sides = now.withColumn("n", F.lit(1)).union(then.withColumn("n", F.lit(-1)))
        done = sides.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty()
        discard(then)
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
