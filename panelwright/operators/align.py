"""Calendar alignment, filling and cleaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import arrays
from panelwright.functions.windows import Frame
from panelwright.params import LOOKBACK_DAYS, MIN_ROWS
from panelwright.schema import FIELDS
from panelwright.sources.bars import as_dates

FRAME = Frame()


def by_date(bars: DataFrame) -> DataFrame:
    """One row per ticker: its bars in order of their dates (``days``), and what is wrong with it (``faults``: date and text).

    ``bars`` may have a column ``fault`` (see ``bars.typed``). Of bars repeated for a date the first by value counts, and
    the repetition is a fault of that date. A fault without a date holds for every date.
    """
    found = [F.sort_array(F.collect_list(F.when(F.col("bar_date").isNotNull(), F.struct("bar_date", F.struct(*FIELDS).alias("b"))))).alias("days")]
    wrong = F.struct("bar_date", F.col("fault").alias("text"))
    if "fault" in bars.columns:
        found.append(F.collect_list(F.when(F.col("fault").isNotNull(), wrong)).alias("faults"))
    else:
        found.append(F.array().cast("array<struct<bar_date:date,text:string>>").alias("faults"))
    rows = bars.groupBy("ticker").agg(*found)
    day = F.col("days")
    again = lambda x, i: (i > 0) & (F.get(day, i - 1)["bar_date"] == x["bar_date"])
    rows = rows.withColumn("repeats", F.filter(day, again))
    repeated = F.transform("repeats", lambda x: F.struct(x["bar_date"], F.concat(F.lit("repeated bar: "), x["bar_date"].cast("string")).alias("text")))
    once = F.when(F.size("repeats") > 0, F.filter(day, lambda x, i: ~again(x, i))).otherwise(day)
    return rows.select("ticker", once.alias("days"), F.concat("faults", repeated).alias("faults"))


def aligned(bars: DataFrame, as_ofs, align: str = "union", lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """(as_of, ticker, bar_date, fields, fault): every ticker on every date of each as-of range's calendar, null where it has no bar.

    With ``align='own'`` each ticker keeps its own dates. Tickers without any close in a range drop out of it, but
    their dates count for the calendar. ``fault`` is the first one in the range, by date.

    The bars of a ticker, at most one per calendar day, are shuffled once, by ticker, whatever the number of
    as-of dates: they are laid out along the calendar once and each range is a slice of that. All windows up to
    the signal are within a ticker, so that shuffle is the only one. The calendar is one row with the dates of all
    ranges, at most one per day, and each range's place among them; it is broadcast.
    """
    if align not in ("union", "own"):
        raise ValueError(f"align must be 'union' or 'own', not {align!r}")
    bars, inside, ranges = _asked(bars, as_ofs, lookback)
    rows = by_date(bars)
    if align == "union":
        calendar = bars.where(inside).agg(F.sort_array(F.collect_set("bar_date")).alias("dates")).select("dates", ranges(F.col("dates")).alias("ranges"))
        # dates without a bar come between the bars by sorting: a lookup in a map would read half of its entries for each date
        none = F.lit(None).cast(rows.schema["days"].dataType.elementType["b"].dataType)
        own = F.transform("days", lambda x: x["bar_date"])
        gaps = F.transform(F.array_except("dates", own), lambda d: F.struct(d.alias("bar_date"), none.alias("b")))
        rows = rows.join(F.broadcast(calendar))
        laid = F.sort_array(F.concat("days", gaps))
        rows = rows.select("ticker", "faults", "ranges", laid.alias("laid"))
    else:
        own = F.transform("days", lambda x: x["bar_date"])
        rows = rows.withColumn("own", own).select("ticker", "faults", ranges(F.col("own")).alias("ranges"), F.col("days").alias("laid"))
    parts = F.transform("ranges", lambda r: F.struct(r["as_of"].alias("as_of"), _fault(r["as_of"], lookback).alias("fault"), F.slice("laid", r["at"], r["n"]).alias("days")))
    live = F.filter(parts, lambda r: F.exists(r["days"], lambda x: x["b"]["close"].isNotNull()))
    spread = rows.select("ticker", F.explode(live).alias("r")).select("r.as_of", "ticker", "r.fault", F.explode("r.days").alias("d"))
    return spread.select("as_of", "ticker", "d.bar_date", *[F.col(f"d.b.{f}").alias(f) for f in FIELDS], "fault")


def _asked(bars: DataFrame, as_ofs, lookback: int):
    """The bars that the as-of dates ask for, whether a bar's date is in their range, and each range's place in a sorted array of dates."""
    asked = as_dates(as_ofs)
    inside = F.col("bar_date").between(F.lit(asked[0] - dt.timedelta(days=lookback)), F.lit(asked[-1]))
    wanted = inside | (F.col("bar_date").isNull() & F.col("fault").isNotNull()) if "fault" in bars.columns else inside
    dates = F.split(F.lit(",".join(map(str, asked))), ",").cast("array<date>")
    # the number of entries of a sorted array before a range, and in it
    before = lambda days, d: F.size(F.filter(days, lambda x: x < F.date_sub(d, lookback)))
    within = lambda days, d: F.size(F.filter(days, lambda x: x.between(F.date_sub(d, lookback), d)))
    ranges = lambda days: F.transform(dates, lambda d: F.struct(d.alias("as_of"), (before(days, d) + 1).alias("at"), within(days, d).alias("n")))
    return bars.where(wanted), inside, ranges


def _fault(d: Column, lookback: int) -> Column:
    return F.array_min(F.filter("faults", lambda f: f["bar_date"].isNull() | f["bar_date"].between(F.date_sub(d, lookback), d)))["text"]


def ranged(bars: DataFrame, as_ofs, align: str = "union", lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """``filled_and_guarded(aligned(...))`` with one row per (as_of, ticker) and its fields as arrays along the range's calendar.

    ``n`` is the calendar's length and ``bar_date`` its last date. Guarded ranges have no arrays. A bar is repeated until
    the next one, so nothing is copied or sorted per date; shuffle and calendar are those of ``aligned``.
    """
    if align not in ("union", "own"):
        raise ValueError(f"align must be 'union' or 'own', not {align!r}")
    bars, inside, ranges = _asked(bars, as_ofs, lookback)
    rows = by_date(bars)
    if align == "union":
        dates = F.col("dates")
        calendar = bars.where(inside).agg(F.sort_array(F.collect_set("bar_date")).alias("dates"))
        # of each day from the first on, the place of the last date so far
        place = F.flatten(F.transform(dates, lambda d, i: F.array_repeat(i, F.coalesce(F.date_diff(F.get(dates, i + 1), d), F.lit(1)))))
        calendar = calendar.select("dates", ranges(dates).alias("ranges"), place.alias("place"), F.get(dates, F.lit(0)).alias("first"))
        rows = rows.join(F.broadcast(calendar))
        at = lambda x, i: F.get(F.col("place"), F.date_diff(x["bar_date"], F.col("first")))
    else:
        own = F.transform("days", lambda x: x["bar_date"])
        rows = rows.withColumn("dates", own).select("ticker", "faults", "days", "dates", ranges(F.col("dates")).alias("ranges"))
        at = lambda x, i: i
    placed = F.transform("days", lambda x, i: F.struct(at(x, i).alias("at"), x["b"].alias("b")))
    rows = rows.select("ticker", "faults", "dates", "ranges", placed.alias("days"))

    def part(r: Column) -> Column:
        skipped = r["at"] - 1
        mine = F.filter("days", lambda x: x["at"].between(skipped, skipped + r["n"] - 1))
        days = F.transform(mine, lambda x: F.struct((x["at"] - skipped).alias("at"), *[x["b"][f].alias(f) for f in FIELDS]))
        return F.struct(r["as_of"].alias("as_of"), F.get("dates", skipped + r["n"] - 1).alias("bar_date"), _fault(r["as_of"], lookback).alias("fault"), r["n"].alias("n"), days.alias("days"))

    # an outer explode, as for another one the optimizer would filter by the array's size and so compute it twice
    spread = rows.select("ticker", F.explode_outer(F.transform("ranges", part)).alias("r")).select("ticker", "r.*")
    some = lambda f: F.exists("days", f)
    spread = spread.where(some(lambda x: x["close"].isNotNull()))
    spread = spread.withColumns({"__v": some(lambda x: x["volume"].isNotNull()), "__bad": some(lambda x: F.coalesce(x["close"] <= 0, F.lit(False)))})
    spread = spread.withColumns(_labels(F.col("n") < MIN_ROWS, ~F.col("__v"), F.col("__bad"), F.col("fault")))

    def along(f: str) -> Column:
        """A field's values, each repeated until the next; the first one also before it."""
        until = lambda x, i, xs: F.coalesce(F.get(xs, i + 1)["at"], F.col("n")) - F.when(i > 0, x["at"]).otherwise(0)
        values = arrays.let(F.filter("days", lambda x: x[f].isNotNull()), lambda xs: F.flatten(F.transform(xs, lambda x, i: F.array_repeat(x[f], until(x, i, xs)))))
        return F.when(F.col("status").isNull(), F.transform(values, _clean) if f == "volume" else values)

    return spread.select("as_of", "ticker", "bar_date", "status", "status_details", "n", *[along(f).alias(f) for f in FIELDS])


def filled(rows: DataFrame, frame: Frame = FRAME) -> DataFrame:
    """Each column forward, then backward filled within a ticker."""
    return rows.withColumns({f: frame.filled(f) for f in FIELDS})


def guarded(rows: DataFrame, frame: Frame = FRAME) -> DataFrame:
    """Adds ``status``, the label of a ticker that can't be computed, with ``status_details``; cleans volumes.

    A null, zero or negative volume is 1 from here on. A fault in the range (see ``bars.typed``, ``by_date``)
    makes its ticker's record an ``Error (Calc)`` with the fault as details; other tickers are as without it.
    """
    return _labelled(rows.withColumns(_checks(frame)))


def filled_and_guarded(rows: DataFrame, frame: Frame = FRAME) -> DataFrame:
    """``guarded(filled(rows))`` in one layer of windows: filling changes neither whether a ticker has values nor which."""
    return _labelled(rows.withColumns({f: frame.filled(f) for f in FIELDS} | _checks(frame)))


def _checks(frame: Frame) -> dict[str, Column]:
    return {"__n": F.count(F.lit(1)).over(frame.whole), "__v": F.count("volume").over(frame.whole), "__bad": F.bool_or(F.col("close") <= 0).over(frame.whole)}


def _labelled(rows: DataFrame) -> DataFrame:
    short, empty, odd = F.col("__n") < MIN_ROWS, F.col("__v") == 0, F.coalesce("__bad", F.lit(False))
    fault = F.col("fault") if "fault" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns(_labels(short, empty, odd, fault) | {"volume": _clean(F.col("volume"))}).drop("__n", "__v", "__bad")


def _labels(short: Column, empty: Column, odd: Column, fault: Column) -> dict[str, Column]:
    status = F.when(short, "Insufficient Data").when(fault.isNotNull(), "Error (Calc)").when(empty, "Insufficient Data").when(odd, "Invalid Data")
    details = F.when(short, "N/A").when(fault.isNotNull(), fault).when(empty, "Missing main series").when(odd, "Non-positive prices detected")
    return {"status": status, "status_details": details}


def _clean(volume: Column) -> Column:
    return F.greatest(F.coalesce(volume, F.lit(0.0)), F.lit(1.0))
