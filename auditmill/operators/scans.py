"""Sequential scans as distributed ones: running sums in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, group: str, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to each, by group and then order.

    Sums of whole groups are made first, and run over on their own: only one row a group meets in one task. A group is one task's."""
    valued = rows.withColumn("_value", value)
    sums = valued.groupBy(group).agg(F.sum("_value").alias("_sum"))
    before = sums.select(F.col(group).alias("_group"), (F.sum("_sum").over(Window.orderBy(group)) - F.col("_sum")).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return valued.withColumn("_own", own).join(before, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_own") + F.col("_before")).drop("_value", "_own", "_group", "_before")
