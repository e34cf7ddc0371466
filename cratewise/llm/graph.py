"""Connected components over an edge table: alternating large-star and small-star rounds, each written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.session import fixed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b: long) links to a smaller one; component is the smallest
    node reachable. Nodes without an edge, and each component's smallest node, are not returned. Self-links and
    repeated or reversed edges count once. The rounds needed grow with the logarithm of a component's width."""
    now = fixed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = fixed(small.union(least).distinct())
