"""Connected components by alternating stars, without a label or edge on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import workspace
from quadloom.llm.workspace import materialize, spread_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    # the centre of a large star has as many edges as the component has nodes
    return spread_join(both.where("v > u"), least.select("u", "m"), "u", least.where(F.col("n") > workspace.HOT_ROWS).select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = spread_join(edges, least.select("u", "m"), "u", least.where(F.col("n") > workspace.HOT_ROWS).select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another (u, v longs); component is the least node.

    Each round writes its edges to the shared folder. The rounds grow with the
    logarithm of a component's diameter; stars take one.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark = materialize(now, "edges"), None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        # a forest of stars: each node has one edge and no centre has one of its own
        if found[0] == found[2] and now.select("u").intersect(now.select(F.col("v").alias("u"))).isEmpty():
            break
        if tuple(found) == mark:
            break
        mark = tuple(found)
        now = materialize(_small_star(_large_star(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
