"""Connected components of links by alternating star operations, each round one written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import saved


def split_join(rows: DataFrame, one_each: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to a table with a row per key, so that Spark can split the rows of a hot key.

    Spark splits a partition of a join only where both sides were shuffled for it.  Wrapped in a
    struct, the key is not the one that ``one_each`` was grouped by, so it is shuffled once more.
    """
    wrapped = F.struct(*keys).alias("__key")
    small = one_each.select(wrapped, *[c for c in one_each.columns if c not in keys])
    return rows.select("*", wrapped).join(small, "__key", how).drop("__key")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of ``links`` (u, v): the smallest node reachable.

    Large-star hangs the larger neighbours of each node on its least neighbour; small-star does
    so with the smaller ones.  Rounds end when every node hangs directly on its component's least
    node, after about the logarithm of the longest path.  Each round is a written table, so a
    lost executor costs at most one round.  No links give no rows; loops are ignored.
    """
    edges = saved(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = split_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one least node only, which hangs on nothing itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return seen.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()
