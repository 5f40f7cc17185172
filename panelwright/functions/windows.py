"""Window expressions over one ticker's rows in date order.

All functions take a ``Frame``, which fixes the partition keys once, so that every window of a plan has
the same partitioning and order: one shuffle and one sort serve them all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scans import decayed


@dataclass(frozen=True)
class Frame:
    keys: tuple[str, ...] = ("as_of", "ticker")
    order: str = "bar_date"

    @property
    def ordered(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last_rows(self, n: int):
        return self.ordered.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        """The whole partition, with the order kept so that no second sort is planned."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def sma(self, x: str, n: int) -> Column:
        """Mean of the last n rows; NULL unless all n are there and not NULL."""
        f = self.last_rows(n)
        return F.when(F.count(x).over(f) == n, F.avg(x).over(f))

    def stdev(self, x: str, n: int) -> Column:
        """Sample standard deviation of the last n rows, guarded like ``sma``."""
        f = self.last_rows(n)
        return F.when(F.count(x).over(f) == n, F.stddev_samp(x).over(f))

    def lag(self, x: str, k: int = 1) -> Column:
        return F.lag(x, k).over(self.ordered)

    def diff(self, x: str, k: int = 1) -> Column:
        return F.col(x) - self.lag(x, k)

    def mean(self, x: str) -> Column:
        return F.avg(x).over(self.whole)

    def deviation(self, x: str) -> Column:
        return F.stddev_samp(x).over(self.whole)

    def centred(self, function, x: str, k: int) -> Column:
        """A function of the 2k+1 rows around each row; NULL where the frame is cut off."""
        f = self.ordered.rowsBetween(-k, k)
        return F.when(F.count(F.lit(1)).over(f) == 2 * k + 1, function(x).over(f))

    def carried(self, x: Column) -> Column:
        """The last value so far that is not NULL."""
        return F.last(x, ignorenulls=True).over(self.so_far)

    def filled(self, x: str) -> Column:
        """Forward fill, then backward fill.

        After the forward fill only leading rows are null, and what follows them first is the first value
        of the partition; a frame from each row to the end would be read anew for every row.
        """
        return F.coalesce(self.carried(F.col(x)), F.first(x, ignorenulls=True).over(self.whole))

    @property
    def row(self) -> Column:
        """Row number from 0."""
        return F.row_number().over(self.ordered) - 1

    @property
    def is_last(self) -> Column:
        return F.lead(self.order).over(self.ordered).isNull()

    def wilder_rsi(self, rows: DataFrame, gain: str, loss: str, row: str, n: int, adjust: bool = True, span: int | None = None, name: str = "rsi") -> DataFrame:
        """Adds 100 * average gain / (average gain + average loss), exponentially averaged with factor 1/n.

        The common divisor of both averages cancels, so decayed running sums do. NULL before n values and for 0 / 0.
        Where ``span``, a bound of the partition's rows, allows, the sums are running sums weighted by (1 - 1/n) ** -row;
        else they come from a scan (see ``scans.decayed``), for any number of rows. Without ``adjust`` the first
        value starts the average instead of being weighted like the rest.
        """
        first = lambda c: F.when(F.col(row) == 1, F.col(c) * n).otherwise(F.col(c)) if not adjust else F.col(c)
        if span is not None and span * math.log(n / (n - 1.0)) <= 600:
            weight = F.pow(F.lit(n / (n - 1.0)), F.col(row))
            up, down = (F.sum(first(c) * weight).over(self.so_far) for c in (gain, loss))
            rows = rows.withColumn(name, F.struct(up.alias("up"), down.alias("down")))
            up, down = F.col(f"{name}.up"), F.col(f"{name}.down")
        else:
            rows = rows.withColumns({"__up": first(gain), "__down": first(loss)})
            rows = decayed(rows, self.ordered, 1 - 1 / n, {"__up": "__up", "__down": "__down"}, span)
            up, down = F.col("__up"), F.col("__down")
        return rows.withColumn(name, F.when(F.count(gain).over(self.so_far) >= n, F.try_divide(up * 100.0, up + down))).drop("__up", "__down")
