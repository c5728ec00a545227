"""Connected components by alternating stars, all of it joins and combinable minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import stored, tidied


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them: the larger ones, or the node and its smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
        moved = both.join(low, F.col("a") == F.col("_a")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), "_m")
        moved = (edges.join(low, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
                 .unionByName(low.select(F.col("_a").alias("a"), F.col("_m").alias("b"))))
    return moved.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


@tidied
def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node that ``edges`` (a, b) touches, but roots.

    Each round halves the depth of the trees; the edges are stored between rounds. Edges that are stars already take no round.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    while not _settled(now):
        now = stored(_star(stored(_star(now, True)), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges to smaller nodes are stars: no node has two of them, or has one and is the end of others."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e"))
    per = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return per.filter((F.col("ups") > 0) & (F.col("n") > 1)).isEmpty()
