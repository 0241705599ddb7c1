"""Positions over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waystone.operators.storage import pinned


def global_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's position (from 1) in the order of columns that tell all rows apart.

    Rows are dealt to ranges, numbered where they lie, and moved on by the sizes of the ranges before (broadcast: a row a range).
    """
    spark = df.sparkSession
    ranged = pinned(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_id", F.monotonically_increasing_id())  # the partition, and in the lower 33 bits the place in it
    ranged = ranged.withColumns({"_range": F.shiftright("_id", 33), "_own": F.col("_id").bitwiseAND((1 << 33) - 1) + 1})
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_id", "_range", "_own", "_before")


def running_count(df: DataFrame, group: str, line: str, count: str, name: str, block: int = 1 << 16) -> DataFrame:
    """df with the sum of `count` over all rows of a group up to each, in the order of an integer column `line`.

    Two steps: blocks of consecutive lines are summed, and a block's rows add up from what the blocks before it hold. So a
    group of any size is dealt to many tasks, and one row per block meets in one."""
    blocked = df.withColumn("_block", F.floor(F.col(line) / block))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(group, "_block").agg(F.sum(count).alias("_sum")).select(group, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_block").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.withColumn("_own", F.sum(count).over(own)).join(sums, [group, "_block"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_block", "_own", "_before")
