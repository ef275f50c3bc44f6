"""Intermediate results that later steps read more than once, and running sums over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: in the session's checkpoint folder, which all executors share and which cuts the lineage; in the executors' memory and disks where the session names none."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def running_sum(df: DataFrame, order: list[str | Column], weight: Column, name: str) -> DataFrame:
    """df with the sum of weight over all rows up to each one, in an order without ties.

    Rows are dealt by ranges of the order and summed inside each range; a range's rows get the
    sum of the ranges before it. The one window over the whole has a row per range.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumn("__w", weight))
    totals = dealt.groupBy("__range").agg(F.sum("__w").alias("__t")).select(
        F.col("__range").alias("__of"),
        (F.sum("__t").over(Window.orderBy("__range")) - F.col("__t")).alias("__before"),
    )
    inside = F.sum("__w").over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, inside).join(
        F.broadcast(totals),
        F.col("__range") == F.col("__of"),
    ).withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__of", "__before", "__w")
