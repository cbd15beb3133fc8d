"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges never leave the executors: each step is a grouped minimum and a join on the
node, written to the shared folder, until every edge points at its component's
smallest node.  A node with many neighbours is a hot key of these joins only on
the side that Spark can split, since the other side is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge, but for the roots themselves: root is the smallest node reachable.

    edges: a, b of one type that has an order; loops and repeated edges do no harm, an empty table gives an empty one.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while True:
        least = stored(now.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k")))
        # large star: a node's larger neighbours go to the smallest of its neighbours and itself
        met = now.join(least.select(F.col("a").alias("_a"), F.col("m").alias("_m")), F.col("b") == F.col("_a"), "left")
        if not met.agg(F.count("_m").alias("n")).first()["n"] and not least.agg(F.count_if(F.col("k") > 1).alias("n")).first()["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = stored(met.select("a", F.coalesce("_m", "b").alias("b")).distinct())
        # small star: a node's smaller neighbours and itself go to the smallest of them
        least = stored(now.groupBy("a").agg(F.min("b").alias("m")))
        moved = now.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
