"""Connected components by alternating large-star and small-star steps, on the cluster alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the least of u and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, moves to the least of them (edges have u > v)."""
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """u, root (the least node reachable) for every node of the links (u, v) that isn't a root itself.

    Both steps keep components and end in stars; a hot centre is a plain aggregate and a join that can be
    split (its other side is stored first, as a plain exchange), never a collected group.  The number of rounds grows with the logarithm of the longest path."""
    spark = links.sparkSession
    edges = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    was = None
    while True:
        edges = saved(_small_star(saved(_large_star(edges), "large")), "stars")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        release(spark)
        if tuple(state) == was:
            return edges.select("u", F.col("v").alias("root"))
        was = tuple(state)
