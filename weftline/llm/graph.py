"""Connected components of large graphs by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of comparable ids -> (id, root): the smallest id of each component with an edge; ids without an edge and
    roots themselves don't appear. A round moves each id to the smallest neighbour; minima are pre-aggregated and written as tables
    of known size, so that small ones are broadcast and joins with large ones can be split where a hub has many edges. The driver
    sees a count and a checksum.
    """
    up = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    up, seen = as_table(up), None
    for _ in range(max_rounds):
        both = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = as_table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = as_table(large)
        low = as_table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = as_table(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(up.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return up.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
