"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a join and an aggregation over edges; nothing is gathered on the driver but whether the edges are stars
by now. Each round is written to the shared folder, so lineage stays short. No side is broadcast, however few its rows:
broadcasts are built in the driver, and many short rounds would fill its memory with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treestat.session import written


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).unionAll(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of them."""
    least = e.groupBy("x").agg(F.min("y").alias("m"))
    rest = e.join(least.hint("merge"), "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return rest.unionAll(least.select("x", F.col("m").alias("y"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root of all nodes that are not the least of their component. ``edges`` has long columns a, b."""
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    for _ in range(most_rounds):
        e = written(_small_star(_large_star(e)), "edges")
        # settled: every node has one edge, to a node that has none
        ends = e.select(F.col("x").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(e.select("y", F.lit(0), F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if ends.filter("out > 1 OR (out > 0 AND in > 0)").isEmpty():
            return e.select(F.col("x").alias("node"), F.col("y").alias("root"))
    raise RuntimeError("components did not settle")
