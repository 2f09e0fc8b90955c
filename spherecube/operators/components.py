"""Connected components by contraction, and their extension by new links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise


def _contracted(links: DataFrame, turn: int) -> DataFrame:
    """(node, into): every node of the links goes into the neighbour, or itself, that a hash of the turn puts first."""
    place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chosen = both.groupBy("a").agg(F.min(place("b")).alias("_first"))
    return chosen.select(F.col("a").alias("node"), F.least(place("a"), F.col("_first"))["node"].alias("into"))


def _followed(names: DataFrame, step: DataFrame) -> DataFrame:
    """(node, into) after one more step; nodes that a step does not move stay. A hot target is spread by Spark's skew join."""
    moved = step.select(F.col("node").alias("into"), F.col("into").alias("_next"))
    return names.join(moved, "into", "left").select("node", F.coalesce("_next", "into").alias("into"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the links (a, b); component is the smallest node of its component.

    In every round each node goes into a neighbour, and the links between what is left make the next, smaller graph. The
    hash differs by round and breaks chains, so the rounds grow with the logarithm of the longest path. Rounds start
    from stored tables.
    """
    links = materialise(links.select("a", "b").where("a is not null and b is not null").distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    names, turn = materialise(nodes.select("node", F.col("node").alias("into"))), 0
    open_ = links.where("a <> b")
    while not open_.isEmpty():
        turn += 1
        step = materialise(_contracted(open_, turn))
        names = materialise(_followed(names, step))
        left, right = (step.select(F.col("node").alias(c), F.col("into").alias(f"_{c}")) for c in "ab")
        lifted = open_.join(left, "a").join(right, "b").where("_a <> _b")
        open_ = materialise(lifted.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    lowest = names.groupBy("into").agg(F.min("node").alias("component"))
    return names.join(lowest, "into").select("node", "component")


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components `known` (node, component) after more links: only components that the new links join are worked on."""
    links = materialise(links.select("a", "b").where("a is not null and b is not null").distinct())
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti")
    known = materialise(known.unionByName(new.withColumn("component", F.col("node"))))
    left, right = (known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    lifted = links.join(left, "a").join(right, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    joined = components(lifted).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return known.join(joined, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
