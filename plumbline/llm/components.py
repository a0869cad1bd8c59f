"""Connected components of a graph of 64-bit nodes, by shrinking stars in a few joins a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.storage import pin


def _mark(pairs: DataFrame) -> tuple:
    """Tells two sets of distinct pairs apart, without a shuffle."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component (least node reachable), for the nodes of edges (a, b).

    Every round hangs a node's larger neighbours, then its smaller ones, on its least neighbour;
    both steps keep what is connected and only shorten paths. It ends when every node hangs on the
    least node of its component. Each step groups by node with at most the edges of the last.
    """
    pairs = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _mark(pairs)
    while seen[0]:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pin(large.where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = pin(small.where("u <> v").distinct())
        mark = _mark(pairs)
        if mark == seen:
            break
        seen = mark
    return _with_roots(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")))


def forest_roots(parents: DataFrame) -> DataFrame:
    """node and component of a forest given as (node, parent), by doubling the steps to the root."""
    current = pin(parents.select("node", "parent"))
    while True:
        above = current.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = current.join(above, "parent", "left")
        moved = F.col("next").isNotNull().alias("moved")
        current = pin(jumped.select("node", F.coalesce("next", "parent").alias("parent"), moved))
        if current.where("moved").isEmpty():
            return _with_roots(current.select("node", F.col("parent").alias("component")))
        current = current.drop("moved")


def _with_roots(found: DataFrame) -> DataFrame:
    """Add the roots themselves, which hang on nothing."""
    roots = found.select("component").distinct()
    return found.union(roots.select(F.col("component").alias("node"), "component"))
