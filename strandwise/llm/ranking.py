"""Places of rows within their groups, without a task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

OUT = ("i", "n")


def ranked(rows: DataFrame, group: str, order: list[str | Column], name: str, cut: list[str | Column] | None = None) -> DataFrame:
    """rows with i, the place (from 0) within the group by `order` (nulls first), and n, the group's size.

    Rows are dealt into ranges of (group, cut) and sorted there, so that a group of any size is spread over tasks; what each range holds
    of a group is counted, and running sums over these few counts tell where each range goes on. cut, where given, says by which
    leading part of the order rows are dealt (short keys: Spark samples them). The group must not be null.
    """
    spread = rows.drop(*OUT).repartitionByRange(group, *(cut or order)).sortWithinPartitions(group, *order)
    placed = materialize(spread.withColumn("__at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    held = placed.groupBy(group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__held"))
    all_, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(group, "__range", "__first", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__before"), F.sum("__held").over(all_).alias("n"))
    offsets = materialize(offsets, f"{name}-offsets")  # a row for each range and group in it
    return placed.join(offsets, [group, "__range"]).withColumn("i", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__range", "__first", "__before")
