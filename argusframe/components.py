"""Connected components of an edge table, without a group or a graph on any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.checkpoints import discard, materialize

MOST_ROUNDS = 60


def settled(links: DataFrame) -> bool:
    """Whether distinct links (hi, lo) are stars: every node points at one other at most, and none that points is pointed at."""
    ends = links.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sums = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return sums.where("up > 1 OR (up > 0 AND down > 0)").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Alternating star contraction: each round points the larger neighbours of every node at the smallest
    node around it, then does the same for the smaller ones, until only stars are left, which takes about as
    many rounds as the logarithm of the longest path. A node's neighbourhood is reduced by a partial
    minimum and joined back, never gathered. Self-loops are dropped and nulls ignored.
    """
    node = F.col(a), F.col(b)
    links = edges.select(F.greatest(*node).alias("hi"), F.least(*node).alias("lo")).where("hi <> lo").distinct()
    links = materialize(links, "components")
    for _ in range(MOST_ROUNDS):
        if settled(links):
            break
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(around, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(below, "hi")
        moved = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(below.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct(), "components")
        discard(links)
        links = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
