"""Counts, pivots, metrics, ordering and report views over the results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.numbering import numbered
from panelwright.operators.signals import is_actionable, is_error
from panelwright.params import BUCKETS, LONG_SIGNALS, OTHER_SECTOR, SHORT_SIGNALS
from panelwright.schema import CRITERIA, RESULTS


def bucket(signal: str = "signal") -> Column:
    """The counted type of a signal: itself, or Error, or Neutral."""
    return F.when(F.col(signal).isin(*BUCKETS), F.col(signal)).when(is_error(signal), "Error").otherwise("Neutral")


def results(signals: DataFrame) -> DataFrame:
    """Records under their display names; absent columns are null."""
    renamed = signals.withColumnsRenamed({"confidence_score": "confidence", "confidence_grade": "grade"})
    extra = [c for c in ("as_of", "seq", "sector") if c in renamed.columns]
    have = set(renamed.columns)
    texts = ("ticker", "signal", "grade", "details", "confidence_class")
    return renamed.select(*extra, *[F.col(c) if c in have else F.lit(None).cast("string" if c in texts else "double").alias(c) for c in RESULTS])


def rank_confidence() -> Column:
    """Confidence to six decimals, as far as it ranks; nearer ones are equal, so that rounding errors order nothing."""
    return F.floor(F.col("confidence") * 1000000.0 + 0.500001)


def ordered(rows: DataFrame, tie: str = "seq") -> DataFrame:
    """Actionable rows by confidence (see ``rank_confidence``), the others after them in universe order.

    A range sort reads its input twice, to sample and to sort; the rows, one per ticker, are dealt out once
    before it, so that what they were computed from isn't computed again.
    """
    act = is_actionable()
    return rows.repartition("ticker").orderBy(act.desc(), F.when(act, rank_confidence()).desc_nulls_last(), tie)


def positions(rows: DataFrame, tie: str = "seq", *keys: str) -> DataFrame:
    """The order of ``ordered`` as a column ``pos`` (from 1), within ``keys`` if given; without them rows are numbered in ranges."""
    act = is_actionable()
    by = [act.desc(), F.when(act, rank_confidence()).desc_nulls_last(), F.col(tie)]
    if not keys:
        return numbered(rows, by, "pos", 1).withColumn("pos", F.col("pos").cast("int"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def top(rows: DataFrame, k: int, tie: str = "seq") -> DataFrame:
    return ordered(rows, tie).limit(k)


def longs(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("signal").contains("Long"))


def shorts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("signal").contains("Short"))


def errors(rows: DataFrame) -> DataFrame:
    return rows.where(is_error())


def neutrals(rows: DataFrame) -> DataFrame:
    return rows.where(~is_actionable())


def displayed(rows: DataFrame) -> DataFrame:
    """Without the criteria columns."""
    return rows.drop(*CRITERIA, "confidence_class")


def missing_tickers(universe: DataFrame, rows: DataFrame) -> DataFrame:
    return universe.select("ticker").distinct().join(rows.select("ticker").distinct(), "ticker", "left_anti")


def signal_counts(rows: DataFrame, missing: int | Column = 0) -> DataFrame:
    """(ord, bucket, n) of all eight types, zero-filled; tickers without data count as errors.

    One aggregation without a key: eight partial counts per task.
    """
    counts = rows.agg(*[F.count_if(bucket() == b).alias(b) for b in BUCKETS])
    extra = missing if isinstance(missing, Column) else F.lit(missing)
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(b).alias("bucket"), (F.col(f"`{b}`") + (extra if b == "Error" else F.lit(0))).cast("long").alias("n")) for i, b in enumerate(BUCKETS)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


# What the tabs of a report say.
NOTES = {
    "Long": "No long signals generated for this analysis period.",
    "Short": "No short signals generated for this analysis period.",
    "Errors": "✅ No errors encountered during analysis!",
}
SOME_ERRORS = "⚠️ {} stocks encountered errors during analysis."


def notes(rows: DataFrame, missing: int | Column = 0) -> DataFrame:
    """(tab, n, note) of the Long, Short and Errors tabs: an empty one says so; errors are announced with the missing tickers counted."""
    extra = missing if isinstance(missing, Column) else F.lit(missing)
    c = rows.agg(F.count_if(F.col("signal").contains("Long")).alias("Long"), F.count_if(F.col("signal").contains("Short")).alias("Short"), F.count_if(is_error()).alias("Errors"))
    n = {"Long": F.col("Long"), "Short": F.col("Short"), "Errors": F.col("Errors") + extra}
    some = F.format_string(SOME_ERRORS.replace("{}", "%d"), n["Errors"])
    note = {t: F.when(F.col(t) == 0, NOTES[t]).otherwise(some if t == "Errors" else F.lit(None).cast("string")) for t in NOTES}
    return c.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), n[t].cast("long").alias("n"), note[t].alias("note")) for t in NOTES])).alias("t")).select("t.*")


def total(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in names])


def sector_pivot(rows: DataFrame) -> DataFrame:
    """Signals by sector and type with totals; ``pos`` orders by Total, ``Other`` last among equals."""
    pivot = rows.withColumn("bucket", bucket()).groupBy("sector").pivot("bucket", list(BUCKETS)).count().na.fill(0)
    pivot = pivot.withColumn("Total", total(BUCKETS))
    pivot = pivot.withColumns({"Total Long": total(LONG_SIGNALS), "Total Short": total(SHORT_SIGNALS)})
    w = Window.orderBy(F.desc("Total"), F.col("sector") == OTHER_SECTOR, "sector")
    return pivot.withColumn("pos", F.row_number().over(w))


def sector_display(pivot: DataFrame) -> DataFrame:
    return pivot.select("sector", "Total Long", "Total Short", "Neutral", *LONG_SIGNALS, *SHORT_SIGNALS, "Total")


def sector_chart(pivot: DataFrame) -> DataFrame:
    """(sector, series, n) of the stacked chart."""
    return pivot.select("sector", "Total Long", "Total Short", "Neutral").unpivot("sector", ["Total Long", "Total Short", "Neutral"], "series", "n")


def ratio(long: Column, short: Column) -> Column:
    return F.when(short == 0, F.lit(float("inf"))).otherwise(F.try_divide(long.cast("double"), short.cast("double")))


def ratio_text(r: Column) -> Column:
    return F.when(r == F.lit(float("inf")), "∞").otherwise(F.format_string("%.2f", r))


def ratio_class(r: Column) -> Column:
    return F.when(r > 1.2, "success").when(r > 0.8, "neutral").otherwise("danger")


def ratio_label(r: Column) -> Column:
    return F.when(r > 1.2, "Bullish").when(r < 0.8, "Bearish").otherwise("Balanced")


def metrics(rows: DataFrame, missing: int = 0) -> DataFrame:
    """One row of everything on the metric cards."""
    is_in = lambda names: F.count_if(bucket().isin(*names))
    conf = F.col("confidence")
    long, short = F.coalesce(F.col("signal").contains("Long"), F.lit(False)), F.coalesce(F.col("signal").contains("Short"), F.lit(False))
    m = rows.agg(
        F.count(F.lit(1)).alias("analysed"),
        is_in(LONG_SIGNALS).alias("total_long"),
        is_in(SHORT_SIGNALS).alias("total_short"),
        is_in(("Neutral",)).alias("total_neutral"),
        (is_in(("Error",)) + missing).alias("total_error"),
        F.count_if(conf >= 80).alias("high_confidence"),
        F.count_if((conf >= 60) & (conf < 80)).alias("medium_confidence"),
        F.count_if((conf > 0) & (conf < 60)).alias("low_confidence"),
        F.coalesce(F.avg(F.when(long, conf)), F.lit(0.0)).alias("avg_long_confidence"),
        F.coalesce(F.avg(F.when(short, conf)), F.lit(0.0)).alias("avg_short_confidence"),
    )
    m = m.withColumn("missing", F.lit(missing).cast("long")).withColumn("ratio", ratio(F.col("total_long"), F.col("total_short")))
    return m.withColumns({"ratio_text": ratio_text(F.col("ratio")), "ratio_class": ratio_class(F.col("ratio")), "ratio_label": ratio_label(F.col("ratio"))})


def cards(m: DataFrame) -> DataFrame:
    """Metric cards as text, with thousands separators."""
    counts = ["analysed", "total_long", "total_short", "total_neutral", "total_error", "high_confidence", "medium_confidence", "low_confidence"]
    return m.select(*[F.format_number(c, 0).alias(c) for c in counts], *[F.format_string("%.1f", c).alias(c) for c in ("avg_long_confidence", "avg_short_confidence")], "ratio_text", "ratio_label")
