"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Join each node's larger neighbours to the least of its neighbourhood."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the least of them; u > v holds."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)


def _settled(e: DataFrame) -> bool:
    """Whether every node hangs on one node only, which hangs on none: each component is a star, and its centre the least."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("v", F.lit(0), F.lit(1)))
    open_ = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)")
    return open_.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component is the least node reachable.

    Null ends and loops are left out; repeated edges and either direction do no harm.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct()
    e = cut(e)
    while not _settled(e):
        e = cut(_small_star(_large_star(e)).where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
