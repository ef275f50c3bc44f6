"""Connected components of an edge list by alternating large-star and small-star rounds.

Each round is two aggregations that combine before the shuffle and joins whose large
partitions Spark can split, so a node with very many neighbours doesn't meet in one task.
Rounds are written to the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node it is connected with, as a stored table. Only nodes with edges; loops are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, mark = stored(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            out = stored(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct(), "components")
            drop(e)
            return out
        mark = tuple(now)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(
            F.col("v").alias("u"),
            F.col("m").alias("v"),
        ).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        keep = low.select(F.col("u").alias("k"), "m")
        small = large.join(keep, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, e = e, stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(old)
