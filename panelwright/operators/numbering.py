"""Numbers and offsets along a total order, without gathering rows in one task.

Rows are dealt to ranges of the order and sorted there. What precedes a range is the sum over the ranges before it, of
which the driver has one number each; within a range rows are counted on.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources import store

#: A row's place in its partition, as far as monotonically_increasing_id counts it.
_PLACE = (1 << 33) - 1


def in_ranges(rows: DataFrame, order: list) -> DataFrame:
    """The rows in ranges of an order, written out: with ``__range`` and ``__place``, the place in it from 0.

    Written, so that ranges stay as they are when they are read again, whatever is lost. Ranges are sampled before they
    are dealt; the rows are dealt out once before that, so that what they were computed from isn't computed twice.
    """
    ranged = rows.hint("rebalance").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("__place"))
    return store.save(placed, "ranges")


def offsets(ranged: DataFrame, size: Column) -> Column:
    """The sum of ``size`` over the ranges before a row's own: a constant array with an entry for each range."""
    sums = {r[0]: r[1] or 0 for r in ranged.groupBy("__range").agg(F.sum(size)).collect()}
    last = max(sums, default=-1)
    before = [0, *accumulate(sums.get(i, 0) for i in range(last))]
    return F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<long>"), F.col("__range"))


def numbered(rows: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Adds the number of each row in an order, from ``start``; rows that the order doesn't tell apart come in any sequence."""
    ranged = in_ranges(rows, order)
    number = offsets(ranged, F.lit(1)) + F.col("__place") + F.lit(start)
    return ranged.withColumn(name, number.cast("long")).drop("__range", "__place")


def summed(rows: DataFrame, order: list, size: str, name: str) -> DataFrame:
    """Adds the sum of ``size`` over all rows before each row in an order."""
    ranged = in_ranges(rows, order)
    before = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    whole = offsets(ranged, F.col(size)) + F.coalesce(F.sum(size).over(before), F.lit(0))
    return ranged.withColumn(name, whole.cast("long")).drop("__range", "__place")
