"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of edges (a, b); edges from a node to itself give no row.

    Alternating large and small stars (Kiveris et al., 2014): neighbours are hung on the smallest node around until only
    stars are left, in about log(n) rounds. Each round is cut off by a checkpoint. A node's minimum is combined before the
    shuffle, so a hub's edges meet only in the join with it, which can be split.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    last = _mark(e)
    while last[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").filter("y > x AND y != m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("z")).select(F.col("z.v").alias("u"), F.col("z.m").alias("v"))
        e = cut(small.filter("u != v").distinct())
        now = _mark(e)
        if now == last:
            break
        last = now
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(e: DataFrame) -> tuple:
    """Equal for equal sets of edges, and else different but for chance."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
