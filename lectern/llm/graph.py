"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root: the smallest node reachable.

    Alternating large-star and small-star rounds, one at least, until the edges are stars: every node has one
    parent and no parent has one. After each round the edges, at most as many as before, are written to the shared
    folder. Nodes may be of any ordered type. Loops and repeated edges do no harm; no edges give an empty result."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    done = not now.limit(1).count()
    while not done:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(small.select(F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(
            F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).alias("e")).select("e.*").distinct())
        done = _stars(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("child")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("child")))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.sum("child").alias("parents"), F.min("child").alias("least"))
    return per.where("parents > 1 or (parents = 1 and least = 0)").limit(1).count() == 0
