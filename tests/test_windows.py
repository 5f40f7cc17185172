"""Window and scalar expressions on hand-made rows, against pandas and by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import scans
from panelwright.functions.scalar import clip, floor_eps, missing_as_null, zero_if_odd
from panelwright.functions.windows import Frame
from panelwright.schema import BARS

W = Frame(("k",), "t")


def series(spark, values):
    return spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, t int, x double")


def run(df, **cols):
    return [r.asDict() for r in df.withColumns(cols).orderBy("t").collect()]


def test_sma_and_stdev_need_full_frames(spark):
    x = [1, 2, None, 4, 5, 6, 9]
    out = run(series(spark, x), m=W.sma("x", 3), s=W.stdev("x", 3))
    want = pd.Series(x, dtype=float).rolling(3)
    for r, m, s in zip(out, want.mean(), want.std()):
        assert (r["m"] is None) == np.isnan(m) and (r["m"] is None or abs(r["m"] - m) < 1e-12)
        assert (r["s"] is None) == np.isnan(s) and (r["s"] is None or abs(r["s"] - s) < 1e-12)


@pytest.mark.parametrize("span", [80, None])
@pytest.mark.parametrize("adjust", [True, False])
def test_wilder_rsi(spark, adjust, span):
    x = pd.Series(np.random.default_rng(1).normal(size=80).cumsum())
    d = x.diff()
    up, down = (s.clip(lower=0).where(d.notna()).ewm(alpha=1 / 9, min_periods=9, adjust=adjust).mean() for s in (d, -d))
    want = 100 * up / (up + down)
    df = series(spark, x).withColumn("d", W.diff("x")).withColumn("row", W.row)
    df = df.withColumns({"g": F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0))), "l": F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0)))})
    out = W.wilder_rsi(df, "g", "l", "row", 9, adjust, span).orderBy("t").collect()
    for r, w in zip(out, want):
        assert (r["rsi"] is None) == np.isnan(w) and (r["rsi"] is None or abs(r["rsi"] - w) < 1e-9)


def recurrence(xs, decay):
    y, out = 0.0, []
    for x in xs:
        y = y * decay + (x or 0.0)
        out.append(y)
    return out


def test_rsi_of_a_long_history(spark):
    """100,000 rows, with stretches in which nothing moves."""
    n = 100_000
    r = np.random.default_rng(7)
    d = r.normal(size=n)
    d[20_000:22_000] = 0
    d[50_000:59_000] = 0  # long enough for a decayed sum to vanish
    frame = pd.DataFrame({"k": "a", "t": np.arange(n), "g": np.maximum(d, 0), "l": np.maximum(-d, 0)})
    df = spark.createDataFrame(frame).withColumn("row", F.col("t"))
    out = W.wilder_rsi(df, "g", "l", "row", 9).orderBy("t").select("rsi").toPandas()["rsi"].to_numpy()
    up, down = np.array(recurrence(frame.g, 8 / 9)), np.array(recurrence(frame.l, 8 / 9))
    sure = np.arange(n) >= 8
    sure[56_000:59_000] = False  # the plain sums become too small to divide there
    assert np.abs(out[sure] - (100 * up / np.where(up + down > 0, up + down, 1))[sure]).max() < 1e-9
    assert np.isnan(out[:8]).all() and np.isnan(out[58_900:59_000]).all()


@pytest.mark.parametrize("decay", [8 / 9, 0.5, 1e-3])
def test_blocks_are_scanned_like_one_sequence(spark, decay):
    r = np.random.default_rng(2)
    rows = [(k, i, int(i**0.5) // 7 if k == "a" else i // 700, None if i % 11 == 0 else float(r.normal())) for k in "ab" for i in range(2000 if k == "a" else 1500)]
    df = spark.createDataFrame(rows, "k string, t int, b int, x double").repartition(5)
    out = scans.decayed_by_blocks(df, ("k",), "b", ("t",), decay, {"y": "x"}, "n").toPandas().sort_values(["k", "t"])
    for k in "ab":
        mine = out[out.k == k]
        assert mine.n.tolist() == list(range(1, len(mine) + 1))
        assert np.abs(mine.y.to_numpy() - np.array(recurrence([x for a, _, _, x in rows if a == k], decay))).max() < 1e-9
    assert scans.decayed_by_blocks(df.limit(0), ("k",), "b", ("t",), decay, {"y": "x"}, "n").count() == 0


def test_rounds_of_a_scan():
    assert scans.rounds(8 / 9, 251) == 8 and scans.rounds(8 / 9) == 13 and scans.rounds(0.5, 1) == 0 and scans.rounds(0.0) == 0
    assert (8 / 9) ** (2 ** scans.rounds(8 / 9)) == 0.0


def test_rsi_of_a_constant_is_null(spark):
    df = series(spark, [0] * 20).withColumn("row", W.row)
    for span in (20, None):
        assert {r.rsi for r in W.wilder_rsi(df, "x", "x", "row", 9, span=span).collect()} == {None}


def test_fill_lag_diff_last(spark):
    out = run(series(spark, [None, 2, None, 5, None]), f=W.filled("x"), lag=W.lag("x", 1), d=W.diff("x", 2), last=W.is_last, row=W.row)
    assert [r["f"] for r in out] == [2, 2, 2, 5, 5] and [r["lag"] for r in out] == [None, None, 2, None, 5]
    assert [r["d"] for r in out] == [None, None, None, 3, None]
    assert [r["last"] for r in out] == [False] * 4 + [True] and [r["row"] for r in out] == [0, 1, 2, 3, 4]


def test_centred_frames_are_whole(spark):
    out = run(series(spark, [3, 1, 2, 1, 5]), m=W.centred(F.min, "x", 1))
    assert [r["m"] for r in out] == [None, 1, 1, 1, None]


def test_scalars(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (None, nan, inf, -inf, 0.0, -3.0, 30.0)], "x double")
    out = df.select(clip(F.col("x"), -1, 1).alias("c"), zero_if_odd(F.col("x")).alias("z"), missing_as_null(F.col("x")).alias("n"), floor_eps(F.col("x")).alias("f")).collect()
    assert [r.z for r in out] == [0, 0, 0, 0, 0, -3, 30]
    assert out[0].c is None and out[6].c == 1 and out[5].c == -1
    assert out[1].n is None and out[4].f == 1e-10 and out[5].f == 1e-10 and out[0].f is None


def test_one_shuffle_and_one_sort_serve_all_layers(spark):
    from panelwright.operators import indicators
    from panelwright.plans import analysis

    days = [(f"T{k}", dt.date(2001, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5, 3.0) for k in range(2) for i in range(60)]
    bars = spark.createDataFrame(days, "ticker string, bar_date date, open double, high double, low double, close double, volume double")
    rows = indicators.computed(analysis.panel(bars, "2001-03-01", "own"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    sorts = [x for x in plan.splitlines() if "Sort [as_of" in x]
    assert len(exchanges) == 1 and len(sorts) == 1, plan


def test_bars_are_shuffled_once_whatever_the_number_of_dates(spark):
    from panelwright.operators import align
    from panelwright.plans import analysis

    start = dt.date(2000, 1, 1)
    days = [(f"T{k}", start + dt.timedelta(days=i), 1.0 + k, 2.0 + i % 5, 0.5, 1.5 + (i * k) % 3, 3.0) for k in range(3) for i in range(0, 600, 1 + k)]
    bars = spark.createDataFrame(days, BARS)
    plans = {}
    for n in (6, 60):
        asked = [start + dt.timedelta(days=300 + 236 * i // (n - 1)) for i in range(n)]  # of the same range
        df = align.aligned(bars, asked)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # what is copied for each date, the explode, comes after the exchange of bars
        below = plan[plan.index("Exchange hashpartitioning(ticker") :]
        assert "Generate" not in below and plan.count("Exchange hashpartitioning") == 1, plan
        plans[n] = (plan.count("Exchange"), *written(df))
    assert plans[6] == plans[60] and plans[6][1] <= len(days)
    several = {(r.as_of, r.ticker): r for r in analysis.signals(bars, asked).collect()}
    for day in (asked[0], asked[31]):
        alone = {(r.as_of, r.ticker): r for r in analysis.signals(bars, day).collect()}
        assert alone and all(several[k] == r for k, r in alone.items())


def written(df):
    """Records and bytes written to the exchange by ticker when the plan is run."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        else:
            if name == "Exchange" and "hashpartitioning(ticker" in p.toString().splitlines()[0]:
                found.append([p.metrics().apply(m).value() for m in ("shuffleRecordsWritten", "shuffleBytesWritten")])
            todo += [p.children().apply(i) for i in range(p.children().size())]
    assert len(found) == 1
    return found[0]
