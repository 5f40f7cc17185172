"""Splits and dividends: bars made comparable over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.schema import PRICES


def adjusted(bars: DataFrame, actions: DataFrame, until=None) -> DataFrame:
    """Bars with prices and volumes adjusted for all later actions.

    ``actions`` has (ticker, action_date, ratio, dividend): new shares for an old one, and cash for a share held before
    the date; either may be NULL. A bar is adjusted for each action with a date after its own: prices are divided by the
    ratio and multiplied by 1 - dividend / close, with the last close before the action's date as it was paid; volumes
    are multiplied by the ratio. With ``until`` only actions up to that date count.

    Actions and bars are one relation, shuffled once by ticker: what an action needs is the running last close, and a
    bar's factors are running products from the end, so no action meets each bar before it.

    Edge cases: actions without a ticker or date, ratios that aren't positive, and dividends that aren't positive or
    reach the close count for nothing, as does a dividend before the first close; several actions of a date all count;
    tickers without actions keep their bars; NULL values stay NULL, repeated bars stay, bars without a date aren't adjusted;
    other columns of ``bars`` are kept.
    """
    acts = actions.where("ticker is not null and action_date is not null")
    if until is not None:
        acts = acts.where(F.col("action_date") <= F.lit(until))
    ratio, paid = F.col("ratio").cast("double"), F.col("dividend").cast("double")
    acts = acts.select("ticker", F.to_date("action_date").alias("bar_date"), F.when(ratio > 0, ratio).alias("__ratio"), F.when(paid > 0, paid).alias("__paid"), F.lit(0).alias("__kind"))
    both = bars.withColumn("__kind", F.lit(1)).unionByName(acts, allowMissingColumns=True)
    # the actions of a date come before its bar
    before = Window.partitionBy("ticker").orderBy("bar_date", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__held", F.last("close", ignorenulls=True).over(before))
    cash = F.when(F.col("__paid") < F.col("__held"), 1 - F.try_divide("__paid", "__held"))
    both = both.withColumns({"__ratio": F.coalesce("__ratio", F.lit(1.0)), "__cash": F.coalesce(cash, F.lit(1.0))})
    later = Window.partitionBy("ticker").orderBy(F.desc("bar_date"), F.desc("__kind"), "__ratio", "__cash").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"__shares": F.product("__ratio").over(later), "__price": F.product("__cash").over(later)})
    dated = F.col("bar_date").isNotNull()
    factor = F.when(dated, F.try_divide("__price", "__shares")).otherwise(1.0)
    changed = {**{p: F.col(p) * factor for p in PRICES}, "volume": F.col("volume") * F.when(dated, F.col("__shares")).otherwise(1.0)}
    return both.where("__kind = 1").withColumns(changed).select(*bars.columns)
