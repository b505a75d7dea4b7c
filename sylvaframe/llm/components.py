"""Connected components by alternating large-star and small-star steps.

Each step is a hash aggregate for the smallest neighbour and an equality join, so no component is ever
gathered in one task or on the driver. The edge list is stored after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import spread_join, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node reachable. Nodes without an edge are absent.

    Loops and repeated edges are ignored; an empty edge table gives an empty result.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = mark
        middle = stored(_large_star(now), replaces=now)
        now = stored(_small_star(middle), replaces=middle)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = spread_join(both.where("v > u"), least.drop("n"), "u", least, F.col("v"))
    return moved.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, least.drop("n"), "hi", least, F.col("lo")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
