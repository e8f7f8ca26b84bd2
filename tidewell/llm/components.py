"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import stash, unstash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours of each vertex are linked to the least vertex of its closed neighbourhood: the larger ones, or the smaller ones and itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a")
    out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, label) of every vertex of edges (a, b): label is the least vertex of its component. The result reads a stashed table."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    for _ in range(rounds):
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == mark or not sign[0]:
            break
        mark = sign
        after = stash(_star(_star(now, True), False), "cc")
        unstash(now)
        now = after
    else:
        raise RuntimeError("components have not settled")
    out = now.select(F.col("a").alias("v"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())
    out._tidewell_stash = now._tidewell_stash
    return out
