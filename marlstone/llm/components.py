"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Nodes that hold more than one row in SHARE go to all tasks: less than SHARE of them, whatever the input.
SHARE = 500


def _with_least(both: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) with m, the least v of each u; the centre of a large star is not gathered in one task."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    often = F.col("n") * SHARE > total
    large = F.broadcast(least.filter(often).select("u", "m"))
    others = both.join(large.select("u"), "u", "left_anti").join(least.filter(~often).select("u", "m"), "u")
    return both.join(large, "u").unionByName(others)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v), two longs; the label is the least node that it is connected to.

    Each round links all neighbours of a node to the least of them, first the larger
    ones, then the smaller ones, until nothing changes: a number of rounds that grows
    with the logarithm of the longest path.  Only sums reach the driver.  Edges may
    repeat, in either direction; loops and an empty table are fine.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = common.stored(edges)
    before = None
    while (now := _signature(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * now[0]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = common.stored(large.filter("u <> v").distinct())
        small = _with_least(large, large.count()).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = common.stored(small.select(F.greatest("e.a", "e.b").alias("u"), F.least("e.a", "e.b").alias("v")).filter("u <> v").distinct())
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
