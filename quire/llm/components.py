"""Connected components by alternating large-star and small-star.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected Components in MapReduce and Beyond (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of u to the smallest of u and its neighbours. Rows of one u lie together."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    linked = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # What follows goes by u, of which each has a row for each of its smaller neighbours.
    return linked.repartition("u").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and every smaller neighbour of u to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads to a vertex that leads nowhere, and no vertex has two edges: all are stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select(F.col("v"), F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not seen.filter("out > 1 OR out = 1 AND into = 1").head(1)


def connected_components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(u, component) of every vertex that is not the smallest of its component.

    edges: columns u and v of one orderable type; loops and nulls are ignored, direction and repeats don't
    matter, no edges give no rows. Each round is written to the shared folder, and nothing but whether all edges
    form stars comes to the driver. The rounds grow with the logarithm of the largest component.
    """
    edges = stored(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    for _ in range(most):
        before, edges = edges, stored(_small_star(_large_star(edges)), "edges")
        discard(before)
        if _settled(edges):
            return edges.select("u", F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {most} rounds")
