"""Faults confined to their ticker, and bars adjusted for splits and dividends."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import align
from panelwright.plans import analysis
from panelwright.schema import BARS, FIELDS
from panelwright.sources import bars as bar_sources
from panelwright.sources.actions import adjusted

DAY = dt.date(2001, 6, 30)
ACTIONS = "ticker string, action_date date, ratio double, dividend double"


def some_bars(tickers, n=60, end=DAY):
    r = random.Random(3)
    return [(t, end - dt.timedelta(days=i), *(float(r.randrange(90, 110)) for _ in range(4)), 100.0 + i) for t in tickers for i in range(n)]


def test_repeated_bars_are_an_error_of_their_ticker_only(spark):
    rows = some_bars("ABC")
    want = {r.ticker: r for r in analysis.signals(spark.createDataFrame(rows, BARS), DAY).collect()}
    again = [*rows, rows[5], ("B", *rows[60 + 7][1:3], 999.0, *rows[60 + 7][4:]), rows[60 + 9]]
    got = {r.ticker: r for r in analysis.signals(spark.createDataFrame(again, BARS).repartition(4), DAY).collect()}
    assert got["C"] == want["C"]
    assert (got["A"].signal, got["A"].details) == ("Error (Calc)", f"repeated bar: {rows[5][1]}")
    assert (got["B"].signal, got["B"].details, got["B"].confidence_grade) == ("Error (Calc)", f"repeated bar: {rows[60 + 9][1]}", "D")
    assert got["A"].vol_surge is None


def test_a_fault_counts_where_its_range_holds_it(spark):
    rows = some_bars("AB", 300)
    old = rows[200]
    df = spark.createDataFrame([*rows, old], BARS)
    late, early = DAY, old[1] + dt.timedelta(days=20)
    got = {(r.as_of, r.ticker): r.signal for r in analysis.signals(df, [late, early], lookback=90).collect()}
    assert got[early, "A"] == "Error (Calc)" and got[late, "A"] != "Error (Calc)" and got[early, "B"] != "Error (Calc)"
    for align_on in ("own", "union"):
        out = align.aligned(df, [late, early], align_on, 90)
        assert out.where("fault is not null").select("as_of", "ticker").distinct().collect() == [(early, "A")]
        assert out.groupBy("as_of", "ticker", "bar_date").count().where("count > 1").count() == 0


def test_extreme_numbers_end_no_run(spark):
    rows = some_bars("A", 80)
    want = analysis.signals(spark.createDataFrame(rows, BARS), DAY).collect()
    nan, inf, big = float("nan"), float("inf"), 1e308
    odd = [("huge", (big, big, big, big, big)), ("nothing", (0.0,) * 5), ("below", (-1.0, -1.0, -1.0, -1.0, 1e-10)), ("nan", (nan,) * 5), ("inf", (inf, inf, -inf, inf, inf)), ("mixed", (1.0, -big, big, 1e-308, -5.0))]
    more = [(t, DAY - dt.timedelta(days=i), *(x if i % 3 else abs(x) for x in v)) for t, v in odd for i in range(80)]
    got = {r.ticker: r for r in analysis.signals(spark.createDataFrame(rows + more, BARS), DAY).collect()}
    assert got["A"] == want[0]
    assert all(got[t].signal in ("Invalid Data", "Error (Calc)", "No Data", "Neutral", "Insufficient Data") for t in got if t != "A"), got
    zero = spark.createDataFrame([("A", DAY - dt.timedelta(days=i), 1e-300, None) for i in range(4)], ACTIONS)
    assert adjusted(spark.createDataFrame(rows, BARS), zero).count() == 80


def test_text_dates_and_numbers_that_cannot_be_read(spark):
    rows = [(t, str(d), *map(str, v)) for t, d, *v in some_bars("ABCD")]
    rows[3] = ("A", "2001-02-31", *rows[3][2:])
    rows[60 + 4] = (*rows[60 + 4][:4], "1,5", *rows[60 + 4][5:])
    rows[120 + 4] = ("C", None, *rows[120 + 4][2:])
    rows[120 + 5] = (*rows[120 + 5][:2], None, "NaN", *rows[120 + 5][4:])
    raw = spark.createDataFrame(rows, "ticker string, bar_date string, open string, high string, low string, close string, volume string")
    typed = bar_sources.typed(raw)
    assert typed.dtypes[:7] == [("ticker", "string"), ("bar_date", "date"), *((f, "double") for f in FIELDS)]
    got = {r.ticker: r for r in analysis.signals(typed, DAY).collect()}
    assert (got["A"].signal, got["A"].details) == ("Error (Calc)", "bar_date is not a date: 2001-02-31")
    assert (got["B"].signal, got["B"].details) == ("Error (Calc)", "low is not a number: 1,5")
    assert "Error" not in got["C"].signal and "Error" not in got["D"].signal
    assert analysis.signals(typed.where("ticker = 'nobody'"), DAY).count() == 0


def brute(rows, actions):
    """Each action changes every bar before it, one after the other from the last."""
    out = []
    for t, day, o, h, low, c, v in rows:
        price = shares = 1.0
        for at, when, ratio, paid in actions:
            if at != t or when is None or when <= day:
                continue
            held = [x[5] for x in sorted(r for r in rows if r[0] == t and r[1] < when and r[5] is not None)]
            if ratio and ratio > 0:
                shares *= ratio
            if paid and held and 0 < paid < held[-1]:
                price *= 1 - paid / held[-1]
        f = price / shares
        out.append((t, day, *(None if x is None else x * f for x in (o, h, low, c)), v * shares))
    return sorted(out)


def same(df, want):
    got = sorted(tuple(r) for r in df.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert all(a == b if None in (a, b) else abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(g[2:], w[2:], strict=True)), (g, w)


def test_adjusted_bars_match_action_by_action(spark):
    r = random.Random(1)
    rows = some_bars("AB", 80) + some_bars("C", 5)
    rows[4] = (*rows[4][:5], None, rows[4][6])
    at = lambda i: DAY - dt.timedelta(days=i)
    acts = [(r.choice("AB"), at(r.randrange(90)), r.choice([None, 2.0, 0.5, 3.0]), r.choice([None, 1.0, 2.5])) for _ in range(14)]
    acts += [("A", at(10), 2.0, 1.0), ("A", at(10), 1.5, None), ("A", at(3), None, 2.0)]  # of one date; after a missing close
    acts += [("A", at(40), 0.0, -1.0), ("A", at(41), -2.0, 500.0), ("A", None, 2.0, 1.0), (None, at(5), 2.0, 1.0), ("C", at(30), None, 5.0), ("nobody", at(5), 2.0, None)]
    bars, actions = spark.createDataFrame(rows, BARS).repartition(3), spark.createDataFrame(acts, ACTIONS)
    same(adjusted(bars, actions), brute(rows, acts))
    until = at(20)
    same(adjusted(bars, actions, until), brute(rows, [a for a in acts if a[1] is None or a[1] <= until]))
    same(adjusted(bars, actions.limit(0)), sorted(rows, key=lambda x: x[:2]))
    assert adjusted(bars.limit(0), actions).count() == 0


def test_adjusting_keeps_columns_and_repeated_rows(spark):
    rows = some_bars("A", 3)
    bars = spark.createDataFrame([*rows, rows[0]], BARS).withColumn("ratio", F.lit("mine")).withColumn("fault", F.lit(None).cast("string"))
    out = adjusted(bars, spark.createDataFrame([("A", DAY, 2.0, None)], ACTIONS))
    assert out.columns == bars.columns and out.count() == 4 and {r.ratio for r in out.collect()} == {"mine"}
    assert sorted(r.volume for r in out.collect()) == [100.0, 100.0, 202.0, 204.0]


def test_a_split_leaves_the_signal_as_it_is(spark):
    """A split that is undone by adjusting gives the records of bars that never split, by one shuffle by ticker."""
    rows = some_bars("AB", 80)
    day = DAY - dt.timedelta(days=30)
    split = [(t, d, *(x * 4 if d < day and t == "A" else x for x in v[:4]), v[4] / 4 if d < day and t == "A" else v[4]) for t, d, *v in rows]
    actions = spark.createDataFrame([("A", day, 4.0, None)], ACTIONS)
    plain = {r.ticker: r for r in analysis.signals(spark.createDataFrame(rows, BARS), DAY).collect()}
    mended = analysis.signals(adjusted(spark.createDataFrame(split, BARS), actions), DAY)
    assert {r.ticker: r for r in mended.collect()} == plain
    assert mended._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the other is the calendar's reading of the same bars
    universe = spark.createDataFrame([(0, "A"), (1, "B")], "seq long, ticker string")
    sectors = spark.createDataFrame([], "ticker string, sector string")
    done = analysis.run(universe, spark.createDataFrame(split, BARS), sectors, DAY, actions=actions, keep=False)
    assert {r.ticker: r.vol_surge for r in done.results.collect()} == {t: r.vol_surge for t, r in plain.items()}


@pytest.mark.parametrize("lookback", [250, 9000])
def test_long_ranges(spark, lookback):
    rows = some_bars("A", 400)
    got = analysis.signals(spark.createDataFrame(rows, BARS), DAY, lookback=lookback).collect()[0]
    assert got.momentum_rsi is not None and 0 <= got.momentum_rsi <= 100
