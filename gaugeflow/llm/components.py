"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, store


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``a, b``, longs): the least node of its component.

    Each round hangs the larger neighbours of every node, then its smaller ones,
    under the least of them; the table of edges never grows, is written every
    round, and rounds grow with the logarithm of the longest path. Repeated
    edges and loops are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    tidy = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, path = store(tidy, "cc")
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(under, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following, new = store(small.unionByName(under.select("a", F.col("m").alias("b"))).distinct(), "cc")
        drop(spark, path)
        current, path = following, new
        # Done when every node hangs under one node only, and that one under none.
        hung = current.select(F.col("a").alias("v"), F.lit(1).alias("under"), F.lit(0).alias("over"))
        over = current.select(F.col("b").alias("v"), F.lit(0).alias("under"), F.lit(1).alias("over"))
        roles = hung.unionByName(over).groupBy("v").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
        if not roles.where("under > 1 or (under = 1 and over = 1)").take(1):
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
