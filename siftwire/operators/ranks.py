"""Positions over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.session import stored

_PLACE_BITS = 33  # monotonically_increasing_id: the task above these bits, the row's place in it below


def ranked(rows: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 0 in the whole order.

    Ranges of the order are sorted each by a task and stored; how many rows the ranges before
    hold, one number a range, is added. Rows equal in ``order`` stand in any order, but for good.
    """
    tie = F.monotonically_increasing_id().alias("__tie")
    ranged = rows.select("*", tie).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie")
    placed = stored(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__task", F.shiftright("__at", _PLACE_BITS))
    sizes = placed.groupBy("__task").agg(F.count("*").alias("n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = sizes.select("__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1) + F.col("__before")
    return placed.join(F.broadcast(offsets), "__task").withColumn(name, place).drop("__at", "__task", "__before")
