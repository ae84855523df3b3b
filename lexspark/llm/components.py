"""Connected components by alternating large and small stars (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(v, m): for each vertex of the edges (a, b), the smallest vertex that it reaches. Each round is staged.

    Rounds grow with the logarithm of the longest path. A hub's edges are never gathered: each star takes one
    minimum per vertex, combined before the shuffle, and one join that skew handling may split.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("l")).select("u", F.least("u", "l").alias("l"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("l").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("l"))
        small = large.join(least, "v").where("m <> l").select(F.col("m").alias("v"), F.col("l").alias("m")).union(least.select("v", F.col("l").alias("m")))
        now = stage(small.where("v <> m").distinct(), "stars")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select("v", "m").union(now.select(F.col("m").alias("v"), "m").distinct())
