"""From masks to one signal per ticker and as-of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.windows import Frame
from panelwright.schema import CRITERIA
from panelwright.sources.bars import as_dates

FRAME = Frame()


def cascade() -> Column:
    """The first matching rule."""
    x_long, x_short, bull, bear = (F.col(c) for c in ("x_long", "x_short", "bull_div", "bear_div"))
    return (
        F.when(x_long & bull, "Extreme Long")
        .when(x_short & bear, "Extreme Short")
        .when(x_long, "Long")
        .when(bull, "Divergence Long")
        .when(x_short, "Short")
        .when(bear, "Divergence Short")
        .otherwise("Neutral")
    )


def last_rows(rows: DataFrame, frame: Frame = FRAME) -> DataFrame:
    """The latest row of each ticker in each as-of range; no second sort."""
    return rows.withColumn("__last", frame.is_last).where("__last").drop("__last")


def classified(last: DataFrame) -> DataFrame:
    """Signal, guard details and criteria of last rows; a guarded ticker has its label and no numbers."""
    odd = F.lit(False)
    for c in CRITERIA:
        odd = odd | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    status = F.coalesce("status", F.when(odd, F.lit("No Data")))
    details = F.when(F.col("status").isNotNull(), F.col("status_details")).when(odd, "Invalid calculation result")
    fine = F.col("status").isNull()
    rows = last.withColumns({"status_details": details, "status": status})
    return rows.select(
        "as_of",
        "ticker",
        "bar_date",
        F.coalesce("status", cascade()).alias("signal"),
        "status_details",
        F.when(fine, F.col("pct_change")).alias("pct_change"),
        *[F.when(fine, F.col(c)).alias(c) for c in CRITERIA],
    )


def no_data(tickers: DataFrame, records: DataFrame, as_ofs) -> DataFrame:
    """Scored records with one more, ``No Data``, for each ticker and as-of date that has none."""
    asked = tickers.select("ticker").distinct().withColumn("as_of", F.explode(F.array(*[F.lit(d) for d in as_dates(as_ofs)])))
    gone = asked.join(records.select("as_of", "ticker"), ["as_of", "ticker"], "left_anti")
    text = F.concat(F.lit("No data at "), F.col("as_of").cast("string"))
    values = {"signal": F.lit("No Data"), "status_details": text, "details": text, "confidence_score": F.lit(0.0), "confidence_grade": F.lit("D"), "confidence_class": F.lit("poor")}
    types = dict(records.dtypes)
    filled = gone.select(*[c if c in ("as_of", "ticker") else values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in records.columns])
    return records.unionByName(filled)


def is_actionable(signal: str = "signal") -> Column:
    return F.coalesce(F.col(signal).rlike("Long|Short"), F.lit(False))


def is_error(signal: str = "signal") -> Column:
    return F.coalesce(F.col(signal), F.lit("")).rlike("Error|Data")


def side(signal: str = "signal") -> Column:
    """Long or Short: the signal's last word, else whichever it contains; null if not actionable."""
    word = F.element_at(F.split(signal, " "), -1)
    return F.when(is_actionable(signal), F.when(word.isin("Long", "Short"), word).when(F.col(signal).contains("Long"), "Long").otherwise("Short"))
