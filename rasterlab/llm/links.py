"""Connected components of links between 64-bit ids, in rounds of joins.

Alternates two star steps until nothing changes: every node ties its larger neighbours to its smallest
one, then its smaller ones. The number of links never grows, and the rounds grow with the logarithm of
the longest path. A hub's smallest neighbour comes from a partial aggregation, and the join that hands
it out is one that Spark can split.
"""

from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.common import stash


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    e = e.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if larger else \
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    kept = e.where("v > u") if larger else e
    moved = kept.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) to (a, b): every linked node ``a`` but the smallest of its component, and that smallest.

    Loops and repeated links do not matter; no links give an empty table.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        edges = stash(_star(stash(_star(edges, True)), False))
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges
        seen = mark
