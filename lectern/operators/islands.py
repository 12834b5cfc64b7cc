"""Runs of consecutive positions (gaps and islands) and running sums, without one task per revision.

A revision can hold a large part of all rows, so positions are scanned in blocks of ``BLOCK``: each block finds its own
runs, and the few rows that describe the blocks are scanned once more to link runs across block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def islands(rows: DataFrame, group: str, position: str, same: Column, kept: Column, block: int = BLOCK) -> DataFrame:
    """Add ``island``: the first position of the run of consecutive positions with equal ``same`` that the row is in.

    Rows that do not meet ``kept`` are dropped and end a run. A missing position ends a run; null equals null; rows
    without group or position are dropped; of rows with the same group and position any one keeps the run going.
    """
    r = rows.where(F.col(group).isNotNull() & F.col(position).isNotNull() & kept).withColumn("_same", same)
    r = r.withColumn("_block", F.floor(F.col(position) / block))
    w = Window.partitionBy(group, "_block").orderBy(position)
    prev_pos, prev_same = F.lag(position).over(w), F.lag("_same").over(w)
    starts = prev_pos.isNull() | (F.col(position) - prev_pos > 1) | ~prev_same.eqNullSafe(F.col("_same"))
    r = r.withColumn("_start", F.when(starts, F.col(position)))
    r = r.withColumn("_own", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = r.groupBy(group, "_block").agg(
        F.min(F.struct(position, "_same")).alias("lo"), F.max(F.struct(position, "_same", "_own")).alias("hi"), F.countDistinct("_own").alias("runs")
    )
    by = Window.partitionBy(group).orderBy("_block")
    before = F.lag("hi").over(by)
    joins = before.isNotNull() & (F.col(f"lo.{position}") - before[position] == 1) & before["_same"].eqNullSafe(F.col("lo._same"))
    ends = ends.withColumn("joins", F.coalesce(joins, F.lit(False)))
    # the run at a block's end: begun in the block, or (one run that goes on from before) wherever that one began
    begun = F.when(~F.col("joins") | (F.col("runs") > 1), F.col("hi._own"))
    ends = ends.withColumn("_begun", F.last(begun, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_from", F.when(F.col("joins"), F.lag("_begun").over(by)))
    links = ends.where("joins").select(group, "_block", F.col(f"lo.{position}").alias("_own"), "_from")
    return r.join(links, [group, "_block", "_own"], "left").withColumn("island", F.coalesce("_from", "_own")).drop("_same", "_block", "_start", "_own", "_from")


def running_sum(rows: DataFrame, group: list[str], position: str, value: Column, block: int = BLOCK) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the group with a smaller position."""
    r = rows.withColumn("_value", value).withColumn("_block", F.floor(F.col(position) / block))
    w = Window.partitionBy(*group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_in", F.coalesce(F.sum("_value").over(w), F.lit(0)))
    by = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy(*group, "_block").agg(F.sum("_value").alias("_sum")).withColumn("_carried", F.coalesce(F.sum("_sum").over(by), F.lit(0)))
    return r.join(sums.drop("_sum"), [*group, "_block"]).withColumn("before", F.col("_carried") + F.col("_in")).drop("_value", "_block", "_in", "_carried")
