"""Places of rows in an order, without one task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.session import shared_folder


def placed(df: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """df with place: 0, 1, ... in each group by the order; a group of any size lies over many sort tasks.

    The sorted rows are checkpointed. What is numbered by group afterwards is one row for each
    group and sort task. Null groups have no row.
    """
    shared_folder(df.sparkSession)
    rows = df.where(F.col(group).isNotNull()).repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(runs, [group, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
