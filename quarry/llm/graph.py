"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(own).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long, a < b): component is the least node reachable.

    Rounds grow with the logarithm of the longest path. Tables of former rounds are dropped.
    """
    now, mark = store(edges.select("a", "b").where("a < b").distinct(), "edges"), None
    for _ in range(max_rounds):
        new = store(_small_star(_large_star(now)), "edges")
        got = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop(now)
        now = new
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError("components did not settle")
    tied = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return tied.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
