"""Bars: scans with a pushed-down date range, other layouts, and bars made from trades."""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import missing_as_null
from panelwright.params import LOOKBACK_DAYS
from panelwright.schema import BARS, FIELDS


#: As-of dates that a plan holds as constants, and pairs of dates that may be broadcast.
DATES, PAIRS = 64, 1_000_000
#: Bars in an Arrow batch made of a wide table.
BATCH = 16_384
#: Trades and bars that one task is dealt.
TRADES, DEALT = 1 << 18, 1 << 18


def tasks(table: DataFrame, each: int) -> int:
    """Tasks of at most about ``each`` rows of a stored table, as many as the cores at least; Parquet's footers count the rows.

    Adaptive execution sizes tasks by the bytes of a shuffle, which says nothing of the rows that are made of them after it.
    """
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // each))


def as_dates(as_ofs) -> list[dt.date]:
    one = isinstance(as_ofs, (str, dt.date))
    return sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in ([as_ofs] if one else as_ofs)})


def not_after(as_of: dt.date, today: dt.date | None = None) -> dt.date:
    """The date, or an error if it lies in the future."""
    if as_of > (today or dt.date.today()):
        raise ValueError(f"the analysis date {as_of} is in the future")
    return as_of


def typed(raw: DataFrame) -> DataFrame:
    """Bars with the types of the schema, NaN as NULL.

    Where a field or the date is text, ``fault`` names the first one that can't be read; its value is NULL, and a bar
    whose date can't be read has a NULL date. Bars whose date is missing are dropped.
    """
    types = dict(raw.dtypes)
    values = [missing_as_null(F.col(f).try_cast("double")).alias(f) for f in FIELDS]
    odd = [F.when(F.col(f).isNotNull() & F.col(f).try_cast("double").isNull(), F.concat(F.lit(f"{f} is not a number: "), F.col(f))) for f in FIELDS if types[f] == "string"]
    day = F.to_date("bar_date")
    if types["bar_date"] == "string":
        day = F.col("bar_date").try_cast("date")
        odd.insert(0, F.when(day.isNull(), F.concat(F.lit("bar_date is not a date: "), F.col("bar_date"))))
    fault = [F.coalesce(*odd).alias("fault")] if odd else []
    return raw.where(F.col("bar_date").isNotNull()).select("ticker", day.alias("bar_date"), *values, *fault)


def scan(spark: SparkSession, path: str, as_ofs, universe: DataFrame | None = None, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """``typed`` bars of a Parquet or CSV table in the range that the as-of dates need; the range reaches a scan of dates."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    days = as_dates(as_ofs)
    first, last = F.lit(days[0] - dt.timedelta(days=lookback)), F.lit(days[-1])
    if universe is not None:
        raw = raw.join(universe.select("ticker"), "ticker", "left_semi")
    if dict(raw.dtypes)["bar_date"] == "string":
        return typed(raw).where(F.col("bar_date").between(first, last) | F.col("bar_date").isNull())
    return typed(raw.where(F.col("bar_date").between(first, last)))


def in_range(bars: DataFrame, as_ofs, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """A copy of each bar for each as-of date whose range holds it (``as_of`` column), from one scan.

    For counts by range; ``align.aligned`` lays ranges out without shuffling copies. Up to DATES dates are constants of
    the plan; more of them are joined by the bar's date.
    """
    days = as_dates(as_ofs)
    ranged = bars.where(F.col("bar_date").between(F.lit(days[0] - dt.timedelta(days=lookback)), F.lit(days[-1])))
    if len(days) > DATES:
        table = bars.sparkSession.createDataFrame([(d,) for d in days], "as_of date")
        every = table.select("as_of", F.explode(F.sequence(F.date_sub("as_of", lookback), "as_of")).alias("bar_date"))
        return ranged.join(F.broadcast(every) if len(days) * (lookback + 1) <= PAIRS else every, "bar_date")
    dates = F.array(*[F.lit(d) for d in days])
    return ranged.withColumn("as_of", F.explode(F.filter(dates, lambda d: (F.col("bar_date") <= d) & (F.col("bar_date") >= F.date_sub(d, lookback)))))


def from_wide(wide: DataFrame, date: str = "bar_date") -> DataFrame:
    """Bars of a table with one column ``ticker|field`` per ticker and field; fields without a column are NULL.

    Arrow columns are laid one below the other, ticker by ticker, so the plan doesn't grow with the tickers, and no
    batch of bars with the table's width: it has about BATCH rows.
    """

    # names are numbers on the way, whatever signs tickers have
    at = {name: i for i, name in enumerate(wide.columns)}
    tickers = sorted({n.rsplit("|", 1)[0] for n in at if n != date and "|" in n})

    def run(batches):
        for batch in batches:
            days = batch.column(at[date])
            step = max(1, BATCH // max(len(days), 1))
            for some in (tickers[i : i + step] for i in range(0, len(tickers), step)):
                field = lambda t, f: batch.column(at[f"{t}|{f}"]).cast(pa.float64()) if f"{t}|{f}" in at else pa.nulls(len(days), pa.float64())  # noqa: B023, E731
                names = pa.concat_arrays([pa.array([t] * len(days), pa.string()) for t in some])
                columns = [names, pa.concat_arrays([days] * len(some)), *[pa.concat_arrays([field(t, f) for t in some]) for f in FIELDS]]
                yield pa.RecordBatch.from_arrays(columns, names=["ticker", "bar_date", *FIELDS])

    columns = wide.toDF(*[f"c{i}" for i in range(len(at))])
    return columns.withColumn(f"c{at[date]}", F.to_date(f"c{at[date]}")).mapInArrow(run, BARS).withColumns({f: missing_as_null(F.col(f)) for f in FIELDS})


def from_frames(frames: dict[str, DataFrame]) -> DataFrame:
    """Bars of one table per ticker."""
    return reduce(DataFrame.unionByName, [df.withColumn("ticker", F.lit(t)).select("ticker", "bar_date", *FIELDS) for t, df in frames.items()])


def with_closes(bars: DataFrame, *keys: str) -> DataFrame:
    """Without tickers whose closes are all null."""
    w = Window.partitionBy(*(keys or ("ticker",)))
    return bars.withColumn("__n", F.count("close").over(w)).where("__n > 0").drop("__n")


def from_trades(trades: DataFrame, suppliers: DataFrame, suffix: str = "", parts: int | None = None) -> DataFrame:
    """Daily bars of a price walk over each supplier's line items.

    One shuffle by supplier serves the walk and the bars. The supplier table is joined after the line
    items have become bars, so that names are not shuffled with them. With ``parts`` the shuffle has so many tasks
    (see ``tasks``); a task sorts its trades, holds its bars in a hash table and sorts them where they are written by date.
    """
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    w = Window.partitionBy("l_suppkey").orderBy(*order)
    step = F.col("l_quantity") - 25.5
    t = trades.select("l_suppkey", "l_quantity", *order)
    if parts is not None:
        t = t.repartition(parts, "l_suppkey")
    t = t.withColumns({"walk": F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)), "seq": F.row_number().over(w)})
    t = t.withColumn("price", F.exp(0.001 * F.col("walk")) * 100.0)
    t = t.withColumn("pre", F.col("price") * F.exp(-0.001 * step)).withColumn("bar_date", F.to_date("l_shipdate"))
    cents = lambda c: F.round(c, 6)
    daily = t.groupBy("l_suppkey", "bar_date").agg(
        cents(F.min_by("pre", "seq")).alias("open"),
        cents(F.max(F.greatest("price", "pre"))).alias("high"),
        cents(F.min(F.least("price", "pre"))).alias("low"),
        cents(F.max_by("price", "seq")).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
    names = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.concat("s_name", F.lit(suffix)).alias("ticker"))
    return daily.join(names, "l_suppkey").select("ticker", "bar_date", *FIELDS)
