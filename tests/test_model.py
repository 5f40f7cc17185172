"""The model on constructed panels: guards, cascade, scores, reports, display."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright import params
from panelwright.functions import scalar
from panelwright.operators import align, display, indicators, report, scoring
from panelwright.operators import signals as sig
from panelwright.plans import analysis, oracle, queries
from panelwright.schema import BARS, CRITERIA

DAY = dt.date(2001, 6, 30)


def bars(spark, **tickers):
    """Bars of each ticker: a list of (open, high, low, close, volume), the last on DAY."""
    rows = [(t, DAY - dt.timedelta(days=len(b) - 1 - i), *(None if x is None else float(x) for x in v)) for t, b in tickers.items() for i, v in enumerate(b)]
    return spark.createDataFrame(rows, BARS)


FLAT = (10, 10, 10, 10, 100)


def records(df, **kw):
    return {r.ticker: r for r in analysis.signals(df, DAY, **kw).collect()}


def walk(n, seed=1):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(r.normal(0, 0.02, n).cumsum())
    o = c * np.exp(r.normal(0, 0.01, n))
    return [(a, max(a, b) * 1.01, min(a, b) * 0.99, b, float(v)) for a, b, v in zip(o, c, r.integers(50, 500, n))]


def test_guards(spark):
    df = bars(spark, A=[FLAT] * 41, B=[FLAT] * 42, C=[(10, 10, 10, 10, None)] * 60, D=[FLAT] * 50 + [(10, 10, 0, 0, 5)] + [FLAT] * 9, E=[(1, 1, 1, None, 1)] * 60)
    out = records(df, align_on="own")
    assert set(out) == set("ABCD")
    assert (out["A"].signal, out["A"].details) == ("Insufficient Data", "N/A") and out["B"].signal == "Neutral"
    assert (out["C"].signal, out["C"].details) == ("Insufficient Data", "Missing main series")
    assert (out["D"].signal, out["D"].details) == ("Invalid Data", "Non-positive prices detected")
    for t in "ACD":
        assert (out[t].confidence_score, out[t].confidence_grade, out[t].confidence_class) == (0.0, "D", "poor")
        assert all(out[t][c] is None for c in CRITERIA) and out[t].pct_change is None
    assert (out["B"].confidence_grade, out["B"].confidence_class) == ("N/A", "neutral")


def test_union_calendar_fills_missing_bars(spark):
    out = records(bars(spark, A=walk(60), N=[FLAT]))
    assert out["N"].signal == "Neutral" and out["N"].vol_surge == 50.0 and out["N"].momentum_rsi == 50.0
    assert records(bars(spark, A=walk(60), N=[FLAT]), align_on="own")["N"].signal == "Insufficient Data"
    with pytest.raises(ValueError, match="align"):
        records(bars(spark, A=walk(60)), align_on="x")


def test_fill_and_volume_cleaning(spark):
    df = bars(spark, A=[(None, 1, 1, 1, None), (2, None, 1, 1, 0), (None, 3, 1, 1, -5), (4, None, 1, 1, None), (None, None, 1, 1, 7)])
    rows = align.guarded(align.filled(align.aligned(df, DAY, "own"))).orderBy("bar_date").collect()
    assert [r.open for r in rows] == [2, 2, 2, 4, 4] and [r.high for r in rows] == [1, 1, 3, 3, 3]
    assert [r.volume for r in rows] == [1, 1, 1, 1, 7]


def test_constant_series_is_neutral(spark):
    rows = indicators.computed(analysis.panel(bars(spark, A=[FLAT] * 60), DAY)).collect()
    assert {r.momentum_rsi for r in rows} == {50.0} and {r.vol_surge for r in rows} == {50.0}
    assert not any(r.overbought or r.oversold for r in rows)


def test_body_conviction(spark):
    body = lambda b: (10, 30, 1, 10 + b, 100)
    for bodies, want in ((range(60), 100), (range(60, 0, -1), 0), ([3] * 60, 0), ([1] * 55 + [5, 5, 0, 5, 7], 100)):
        rows = indicators.computed(analysis.panel(bars(spark, A=[body(b) for b in bodies]), DAY), "body_conviction").orderBy("bar_date").collect()
        assert rows[-1].body_conviction == want and rows[0].body_conviction == 0


def test_pivots(spark):
    lows = [10.0] * 60
    lows[20] = lows[25] = 5.0
    lows[4] = lows[55] = 1.0
    rows = indicators.computed(analysis.panel(bars(spark, A=[(11, 12, x, 11, 10) for x in lows]), DAY), "acceleration_and_last_pivots").orderBy("bar_date").collect()
    flags = [i for i, r in enumerate(rows) if r.pivot_low]
    assert 20 in flags and 25 in flags and 4 not in flags and 55 not in flags
    assert rows[21].last_low == 5.0 and rows[0].last_low == 10.0


def slow(df):
    """The oscillator by pandas, written from the definitions."""
    eps = 1e-10
    z = lambda s: s.replace([np.inf, -np.inf], 0).fillna(0)
    o, h, lo, c = df.open, df.high, df.low, df.close
    v = df.volume.clip(lower=1)
    vm = v.rolling(21).mean().fillna(v.mean())
    liq = z(((h + lo) / 2 - o).mul(v).div(vm).rolling(21).mean().fillna(0) - (c - c.shift(5)).mul(v).div(vm).rolling(21).mean().fillna(0))
    nl = z((liq - liq.rolling(21).mean().fillna(0)) / liq.rolling(21).std().fillna(1).replace(0, 1).clip(lower=eps)).clip(-10, 10)
    vz = z((v - vm) / v.rolling(9).std().fillna(v.std()).replace(0, eps).clip(lower=eps)).clip(-5, 5)
    surge = (50 + 20 * vz).clip(0, 100)
    mf = (h + lo + c) / 3 * v
    pos, neg = (mf.where(m, 0).rolling(9).mean().fillna(0) for m in (c > c.shift(), c < c.shift()))
    score = z(0.5 * surge.where(c > o, -surge) / 100 + 0.5 * z((pos - neg) / (pos + neg + eps)).clip(-1, 1))
    body = (c - o).abs()
    conv = body.rolling(10, min_periods=2).apply(lambda w: (w[:-1] < w[-1]).mean() * 100, raw=True).fillna(0)
    vel = z((c - c.shift()) / c.shift().clip(lower=eps) * 10000).clip(-1000, 1000)
    d = vel.diff()
    up, dn = (x.clip(lower=0).where(d.notna()).ewm(alpha=1 / 9, min_periods=9).mean() for x in (d, -d))
    rsi = (100 * up / (up + dn)).fillna(50)
    osc = (8 * z(0.3 * nl + 0.25 * score + 0.25 * conv.where(c > o, -conv) / 100 + 0.2 * (rsi - 50) / 50).clip(-5, 5)).clip(-10, 10)
    mom = osc.diff(2).clip(-15, 15).fillna(0)
    return pd.DataFrame({"ilfo_value": osc, "vol_surge": surge, "momentum_rsi": rsi, "osc_momentum": mom, "osc_accel": mom.diff().clip(-15, 15).fillna(0), "volume_score": score, "normalized_liq": nl})


def test_oscillator_matches_pandas(spark):
    rows = walk(120, 7)
    got = indicators.computed(analysis.panel(bars(spark, A=rows), DAY)).orderBy("bar_date").toPandas()
    want = slow(pd.DataFrame(rows, columns=["open", "high", "low", "close", "volume"]))
    for c in CRITERIA:
        assert np.allclose(got[c], want[c], atol=1e-8), c
    assert got["ilfo_value"].between(-10, 10).all() and got["vol_surge"].between(0, 100).all() and got["body_conviction"].between(0, 100).all()


def test_row_order_later_rows_and_price_scale_do_not_matter(spark):
    a = bars(spark, A=walk(80, 3), B=walk(80, 4))
    later = spark.createDataFrame([("A", DAY + dt.timedelta(days=1), 1.0, 1.0, 1.0, 1.0, 1.0)], BARS)
    want = sorted(map(tuple, analysis.signals(a, DAY).collect()))
    assert sorted(map(tuple, analysis.signals(a.orderBy(F.rand(1)).union(later), DAY).collect())) == want
    several = analysis.signals(a, [DAY - dt.timedelta(days=9), DAY]).where(F.col("as_of") == F.lit(DAY))
    assert sorted(map(tuple, several.collect())) == want
    k = a.withColumns({f: F.col(f) * 4 for f in ("open", "high", "low", "close")})
    for x, y in zip(sorted(analysis.signals(a, DAY).collect()), sorted(analysis.signals(k, DAY).collect())):
        assert all(abs(x[c] - y[c]) < 1e-6 for c in CRITERIA)


def test_cascade(spark):
    flags = [(bool(i & 1), bool(i & 2), bool(i & 4), bool(i & 8)) for i in range(16)]

    def want(xl, xs, bd, be):
        if xl and bd:
            return "Extreme Long"
        if xs and be:
            return "Extreme Short"
        return "Long" if xl else "Divergence Long" if bd else "Short" if xs else "Divergence Short" if be else "Neutral"

    df = spark.createDataFrame(flags, "x_long boolean, x_short boolean, bull_div boolean, bear_div boolean").withColumn("s", sig.cascade())
    assert all(r.s == want(r.x_long, r.x_short, r.bull_div, r.bear_div) for r in df.collect())


def values(spark, rows):
    return spark.createDataFrame(rows, ", ".join(["side string", *[f"{c} double" for c in CRITERIA]]))


def at(side, what):
    table = {r[1]: r for r in params.rows() if r[0] == side}
    return (side, *[{"median": table[c][7], "far": table[c][7] + 2 * table[c][9], "half": table[c][7] + 0.5 * table[c][9], "none": None}[what] for c in CRITERIA])


def test_scores(spark):
    df = values(spark, [at(s, w) for s in ("Long", "Short") for w in ("median", "far", "half", "none")] + [("x", *[1.0] * 7)])
    got = [r.s for r in df.withColumn("s", scoring.score(F.col("side"))).collect()]
    want = [91, 0, 44, 0, 90, 0, 43.5, 0, 0]
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, want)), got
    keyed = df.where("side <> 'x'").withColumn("id", F.monotonically_increasing_id())
    parts = scoring.breakdown(keyed, ("id",))
    by = {r.id: r.confidence_score for r in scoring.summary(parts, ("id",)).collect()}
    assert all(abs(by[r.id] - r.s) < 1e-9 for r in keyed.withColumn("s", scoring.score(F.col("side"))).collect())
    assert {r.status for r in parts.collect()} == {"missing", "far_from_median", "near_median", "optimal_proximity"} and parts.count() == 8 * 9


def test_bonus_and_percentage(spark):
    df = spark.createDataFrame([(2, 0, 99.0, 100.0), (1, 2, 1.0, 50.0), (1, 1, 1.0, 0.0), (0, 9, 1.0, 100.0)], "c int, h int, t double, m double")
    out = df.select(scoring.bonus(F.col("c"), F.col("h")).alias("b"), scoring.percentage(F.col("t") + 5, F.col("m")).alias("p")).collect()
    assert [r.b for r in out] == [5, 3, 0, 0] and [round(r.p, 6) for r in out] == [100, 12, 0, 6]
    assert params.spread(1.0, 1.0) == 0.1 and params.spread(0.0, 0.0) == 0.1 and params.spread(50.0, 50.0) == 5.0


def test_grades(spark):
    df = spark.createDataFrame([(x,) for x in (90.0, 89.9, 80.0, 79.9, 70.0, 69.9, 60.0, 59.9, 50.0, 49.9, 40.0, 39.9)], "x double")
    assert [r.g for r in df.select(scoring.grade(F.col("x")).alias("g")).collect()] == ["A+", "A", "A", "B+", "B+", "B", "B", "C+", "C+", "C", "C", "D"]


def results(spark):
    rows = [("A", "Long", 85.0, "s1"), ("B", "Extreme Short", 60.0, "s1"), ("C", "Neutral", 0.0, "Other"), ("D", "Insufficient Data", 0.0, "s2"), ("E", "Divergence Long", 85.0, "Other"), ("F", "Error (Calc)", 0.0, "s2"), ("G", "No Data", None, "s2"), ("H", "Invalid Data", 0.0, "s1"), ("I", "Short", 59.9, "s1")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, ticker string, signal string, confidence double, sector string")


def test_reports(spark):
    r = results(spark)
    assert [x.ticker for x in report.ordered(r).collect()] == list("AEBICDFGH")
    assert [x.ticker for x in report.top(r, 2).collect()] == ["A", "E"]
    counts = {x.bucket: x.n for x in report.signal_counts(r, 3).collect()}
    assert counts == {"Extreme Long": 0, "Long": 1, "Divergence Long": 1, "Extreme Short": 1, "Short": 1, "Divergence Short": 0, "Neutral": 1, "Error": 7}
    pivot = report.sector_pivot(r).orderBy("pos").collect()
    assert [(x.sector, x.Total, x["Total Long"], x["Total Short"]) for x in pivot] == [("s1", 4, 1, 2), ("s2", 3, 0, 0), ("Other", 2, 1, 0)]
    m = report.metrics(r, 3).collect()[0]
    assert (m.total_long, m.total_short, m.total_neutral, m.total_error) == (2, 2, 1, 7)
    assert (m.high_confidence, m.medium_confidence, m.low_confidence) == (2, 1, 1)
    assert m.avg_long_confidence == 85 and abs(m.avg_short_confidence - 59.95) < 1e-9 and m.ratio_text == "1.00"
    assert {x.ticker for x in report.errors(r).collect()} == set("DFGH") and report.longs(r).count() == 2 and report.shorts(r).count() == 2 and report.neutrals(r).count() == 5
    none = report.metrics(r.limit(0)).collect()[0]
    assert none.ratio == math.inf and none.avg_long_confidence == 0 and report.signal_counts(r.limit(0)).count() == 8


def test_ratio_labels(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (6, 5), (4, 5), (1, 2), (13, 10)], "l long, s long").withColumn("r", report.ratio(F.col("l"), F.col("s")))
    out = df.select(report.ratio_text(F.col("r")).alias("t"), report.ratio_class(F.col("r")).alias("c"), report.ratio_label(F.col("r")).alias("b")).collect()
    assert [tuple(x) for x in out] == [("∞", "success", "Bullish"), ("∞", "success", "Bullish"), ("1.20", "neutral", "Balanced"), ("0.80", "danger", "Balanced"), ("0.50", "danger", "Bearish"), ("1.30", "success", "Bullish")]


def test_display(spark):
    df = spark.createDataFrame([("Extreme Long", 1.234, 80.0, "A+"), ("Neutral", -1.0, 0.0, "N/A"), ("No Data", None, None, None), (None, 0.0, 59.9, "C+"), ("Short", 2.0, 60.0, "B")], "signal string, pct_change double, confidence double, grade string")
    out = display.cells(df).collect()
    assert out[0][:] == ('<span class="signal-extreme-long">Extreme Long</span>', '<span class="pct-positive">+1.23%</span>', '<span class="confidence-high">80.0%</span>', '<span class="grade-a-plus">A+</span>')
    assert out[1][:] == ('<span class="signal-neutral">Neutral</span>', '<span class="pct-negative">-1.00%</span>', '<span class="pct-neutral">N/A</span>', '<span class="signal-neutral">N/A</span>')
    assert out[2].signal == '<span class="signal-error">No Data</span>' and out[2].pct_change == '<span class="pct-neutral">N/A</span>'
    assert out[3].signal == '<span class="signal-neutral">N/A</span>' and out[3].confidence == '<span class="confidence-low">59.9%</span>' and out[3].grade == '<span class="grade-c-plus">C+</span>'
    assert display.cells(df.limit(0)).count() == 0


def test_details_highlight(spark):
    row = ("Long", 0.362, 72.076, 41.0, 2.0, 0.0, -0.4, 1.5)
    df = spark.createDataFrame([row, ("Short", *row[1:]), ("Neutral", *row[1:])], "signal string, " + ", ".join(f"{c} double" for c in CRITERIA))
    long, short, neutral = (r.d for r in df.select(display.details().alias("d")).collect())
    assert long.count("pct-positive") == 6 and 'MomRSI: <span class="signal-neutral">41.00</span><br>OscMom' in long
    assert short.count("pct-negative") == 2 and "pct-" not in neutral and 'VolSurge: <span class="signal-neutral">72.1</span>' in neutral


def test_odd_results_are_no_data(spark):
    """A value that is null or not finite at the last row; guards come first."""
    good = {"status": None, "status_details": None, "pct_change": 1.0, "x_long": False, "x_short": False, "bull_div": False, "bear_div": False, **{c: 1.0 for c in CRITERIA}}
    rows = [("ok", {}), ("null", {"osc_accel": None}), ("nan", {"vol_surge": math.nan}), ("inf", {"ilfo_value": -math.inf}), ("guard", {"ilfo_value": None, "status": "Invalid Data", "status_details": "why"})]
    schema = "ticker string, as_of date, bar_date date, status string, status_details string, pct_change double, x_long boolean, x_short boolean, bull_div boolean, bear_div boolean, " + ", ".join(f"{c} double" for c in CRITERIA)
    df = spark.createDataFrame([(t, DAY, DAY, *(good | odd).values()) for t, odd in rows], schema)
    out = {r.ticker: (r.signal, r.status_details, r.pct_change) for r in sig.classified(df).collect()}
    assert out == {"ok": ("Neutral", None, 1.0), "guard": ("Invalid Data", "why", None), **{t: ("No Data", "Invalid calculation result", None) for t in ("null", "nan", "inf")}}


def test_parameters_without_anchors(spark):
    table = params.table(spark).withColumns({x: F.when(F.col("param") != "vol_surge", F.col(x)) for x in ("median", "fail_mean", "spread")})
    df = values(spark, [at("Long", "median")]).withColumn("id", F.lit(1))
    parts = {r.param: r for r in scoring.breakdown(df, ("id",), table=table).collect()}
    assert parts["vol_surge"].status == "no_stats" and parts["vol_surge"].contribution == 0 and abs(parts["vol_surge"].max_contribution - 13) < 1e-9
    assert parts["ilfo_value"].status == "optimal_proximity" and scoring.proximity(F.lit(1.0), None, None) is not None


def test_records_of_absent_tickers(spark):
    universe = spark.createDataFrame([(0, "A"), (1, "Z")], "seq long, ticker string")
    no_sectors = spark.createDataFrame([], "ticker string, sector string")
    done = analysis.run(universe, bars(spark, A=walk(60)), no_sectors, DAY, absent=True)
    out = {r.ticker: r for r in done.results.collect()}
    assert (out["Z"].signal, out["Z"].details, out["Z"].grade) == ("No Data", "No data at 2001-06-30", "D") and done.missing_count == 0
    counted = analysis.run(universe, bars(spark, A=walk(60)), no_sectors, DAY, keep=False)
    assert counted.missing_count == 1
    assert {r.tab: r.n for r in counted.notes.collect()}["Errors"] == 1


def test_notes(spark):
    said = {r.tab: (r.n, r.note) for r in report.notes(results(spark), 3).collect()}
    assert said == {"Long": (2, None), "Short": (2, None), "Errors": (7, "⚠️ 7 stocks encountered errors during analysis.")}
    none = {r.tab: r.note for r in report.notes(results(spark).limit(0)).collect()}
    assert none == report.NOTES


def test_printed_decimals_and_their_sql(spark, duck):
    values = [(16.25, 1), (16.249999999999996, 1), (-16.25, 1), (0.125, 2), (-1e-17, 2), (-0.004, 2), (2.0, 2), (1.0049, 2), (None, 2)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(values)], "i int, v double")
    found = {d: {r.i: r.t for r in df.select("i", scalar.printed(F.col("v"), d).alias("t")).collect()} for d in (1, 2)}
    sql = [duck.sql(f"select {oracle.printed(f'({v})::double' if v is not None else 'null::double', d)}").fetchall()[0][0] for v, d in values]
    mine = [found[d][i] for i, (_, d) in enumerate(values)]
    assert mine[:-1] == sql[:-1] == ["16.3", "16.3", "-16.3", "0.13", "0.00", "-0.00", "2.00", "1.00"]


def test_rounding_errors_of_confidence_rank_nothing(spark):
    rows = [("b", 1, 50.00000000000001), ("a", 0, 50.0), ("c", 2, 50.00001)]
    df = spark.createDataFrame([(t, i, "Long", c) for t, i, c in rows], "ticker string, seq long, signal string, confidence double")
    for keys in ((), ("signal",)):
        assert [r.ticker for r in report.positions(df, "seq", *keys).orderBy("pos").collect()] == ["c", "a", "b"]
    assert [r.ticker for r in report.ordered(df).collect()] == ["c", "a", "b"]


def test_adjusted_bars_equal_their_sql_to_the_last_bit(spark, sf, duck):
    mine = queries.adjusted(queries.all_bars(spark, sf), queries.derived_actions(spark, sf))
    mine = {(r.ticker, str(r.bar_date)): (r.open, r.close, r.volume) for r in mine.collect()}
    sql = duck.sql(f"with {oracle.ADJUSTED_BARS} select ticker, bar_date, open, close, volume from bars").fetchall()
    assert {(t, str(d)): tuple(v) for t, d, *v in sql} == mine


def test_last_rows_need_few_rows(spark):
    """The last rows of all layers over all rows, and those of the layers over what they depend on, are the same to the last bit."""
    gone = [(None, None, None, None, None) if i % 7 == 3 else x for i, x in enumerate(walk(200, 9))]
    up = [(100 + i, 101 + i, 99 + i, 100.5 + i, 10 + i % 3) for i in range(120)]
    df = bars(spark, A=walk(251), B=walk(90, 2), C=walk(45, 3), D=walk(30, 4), E=gone, F=up, G=[FLAT] * 60, **{f"W{i}": walk(100 + 3 * i, 20 + i) for i in range(12)})
    rows = analysis.panel(df, ("2001-05-01", "2001-06-30"), "own").cache()
    few = indicators.last_computed(rows)
    assert few.count() < rows.count() / 5
    old, new = (sorted(map(tuple, sig.classified(sig.last_rows(x)).collect()), key=repr) for x in (indicators.computed(rows), few))
    assert len(old) > 30 and old == new


def test_whole_ranges_pass_three_layers_of_windows(spark):
    """A layer copies each row: only three see whole ranges, the others the rows that are kept."""
    rows = analysis.flow_model(analysis.panel(bars(spark, A=walk(60)), ("2001-05-01", "2001-06-30")))
    nodes = [line.strip(" :+-") for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    first_cut = max(i for i, n in enumerate(nodes) if n.startswith("Filter") and "__end" in n)
    spread = next(i for i, n in enumerate(nodes) if n.startswith("Generate"))
    assert sum(n.startswith("Window ") for n in nodes[first_cut:spread]) == 3


def test_filling_and_guarding_in_one_layer_change_nothing(spark):
    gone = [(None, None, None, None, None) if i % 7 == 3 or i < 4 else x for i, x in enumerate(walk(60, 9))]
    no_volume = [(o, h, low, c, None) for o, h, low, c, _ in walk(60, 4)]
    negative = [(o, h, low, -c if i == 30 else c, v) for i, (o, h, low, c, v) in enumerate(walk(60, 5))]
    df = bars(spark, A=walk(60), B=gone, C=walk(30, 3), D=no_volume, E=negative)
    laid = align.aligned(df, ("2001-05-01", "2001-06-30"))
    want, got = (sorted(map(tuple, x.collect()), key=repr) for x in (align.guarded(align.filled(laid)), align.filled_and_guarded(laid)))
    assert want == got and len({r[-2:] for r in want}) == 3
