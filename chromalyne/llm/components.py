"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import Temporary


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, u))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is tied to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (u, v), for every node that has an edge.

    Each step is a grouped minimum (combined before its shuffle) and a join, so no task gathers a node's neighbours;
    a node with very many is split by the skew join. The edges are a written table after each round: there are as many
    rounds as about the logarithm of the longest path. Null ends and loops are left out; an empty table has no nodes.
    """
    tmp = Temporary(edges.sparkSession)
    edges = tmp.written(edges.where("u is not null and v is not null and u != v").distinct(), tag)
    before = _state(edges)
    while before[0]:
        edges = tmp.written(_small_star(_large_star(edges)), tag)
        tmp.drop(last=1)
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
