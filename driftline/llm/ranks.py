"""Positions of rows in a total order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialise

_IN_TASK = 33  # bits of a monotonically increasing id that count within a task


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """``df`` with the 0-based place of each row in ``order``; rows that tie are in any order.

    Rows are dealt out by ranges, counted in each range, and shifted by what
    the ranges before hold. Only one row for each range meets in one task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(placed, "ranges").withColumn("_range", F.shiftright("_id", _IN_TASK))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_range", before.alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit(2**_IN_TASK - 1))
    return placed.join(shifts, "_range").withColumn(name, F.col("_before") + within).drop("_id", "_range", "_before")
