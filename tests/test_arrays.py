"""Array expressions, and last rows of ranges as arrays, against windows."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelwright.functions import arrays
from panelwright.plans import analysis
from panelwright.schema import BARS

ENDS = ("2001-05-01", "2001-06-30")


def test_array_expressions_match_brute_force(spark):
    r = random.Random(5)
    some = [[float(r.randrange(40)) for _ in range(n)] for n in (3, 21, 22, 60, 251)] + [[]]
    some.append([None if i == 30 else v for i, v in enumerate(some[3])])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "i int, x array<double>")
    out = df.select("x", arrays.moving(F.col("x"), 21).alias("m"), arrays.last_centre(F.col("x"), 10, arrays.less).alias("at"), arrays.before(F.col("x")).alias("b"), arrays.total(F.col("x")).alias("t"))
    for x, m, at, b, t in out.collect():
        full = [x[i : i + 21] for i in range(len(x))]
        assert m == [None if len(f) < 21 or None in f else sum(f) for f in full]
        assert t == (None if None in x else sum(x)) and b == ([None] + x)[: max(len(x), 1)]
        if None not in x:
            centres = [i for i in range(10, len(x) - 10) if x[i] == min(x[i - 10 : i + 11])]
            assert at == (centres[-1] if centres else None)
    d = spark.createDataFrame([([0.1] * 9,), (some[1][:9],)], "x array<double>").select(arrays.deviation(F.col("x"), 9)).collect()
    assert d[0][0] == 0 and abs(d[1][0] - statistics.stdev(some[1][:9])) < 1e-12


def walk(n, seed, gap=0):
    r, at, out = random.Random(seed), 100.0, []
    for i in range(n):
        o, at = at, at * (1 + r.uniform(-0.02, 0.02))
        if not gap or r.randrange(gap) == 0:
            out.append((dt.date(2001, 6, 30) - dt.timedelta(days=n - 1 - i), o, max(o, at) * 1.01, min(o, at) * 0.99, at, float(r.randrange(1, 500))))
    return out


@pytest.mark.parametrize("align_on", ["union", "own"])
def test_ranges_as_arrays_give_the_records_of_the_panel(spark, align_on):
    tickers = {f"W{i}": walk(60 + 9 * i, i) for i in range(22)} | {f"G{i}": walk(400, i, 4) for i in range(12)}
    holes = random.Random(1)
    tickers["holes"] = [(d, *(None if holes.randrange(3) == 0 else x for x in v)) for d, *v in walk(251, 50)]
    tickers["flat"] = [(d, 10.0, 10.0, 10.0, 10.0, 5.0) for d, *_ in walk(90, 1)]
    tickers["up"] = [(d, 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 10.0 + i % 3) for i, (d, *_) in enumerate(walk(120, 1))]
    tickers["no open"] = [(d, None, *v[1:]) for d, *v in walk(100, 2)]
    tickers["no prices but closes"] = [(d, None, None, None, *v[3:]) for d, *v in walk(100, 2)]
    tickers["no volume"] = [(*v[:-1], None) for v in walk(100, 3)]
    tickers["no close"] = [(*v[:-2], None, 1.0) for v in walk(100, 3)]
    tickers["negative"] = [(*v[:-2], -v[-2] if i == 50 else v[-2], v[-1]) for i, v in enumerate(walk(100, 4))]
    tickers["short"] = walk(41, 5)
    tickers["twice"] = walk(100, 6) + walk(100, 7)[80:81]
    df = spark.createDataFrame([(t, *v) for t, rows in tickers.items() for v in rows], BARS)
    want, got = ({(r.as_of, r.ticker): r.asDict() for r in x.collect()} for x in (analysis.flow_model(analysis.panel(df, ENDS, align_on)), analysis.flow_signals(df, ENDS, align_on)))
    assert want.keys() == got.keys() and len({r["signal"] for r in want.values()}) > 3
    for key, row in want.items():
        assert {c: v for c, v in row.items() if not isinstance(v, float)} == {c: v for c, v in got[key].items() if not isinstance(v, float)}, key
        assert all(abs(v - got[key][c]) < 1e-9 for c, v in row.items() if isinstance(v, float)), (key, row, got[key])


def test_windows_of_signals_see_few_rows_of_a_range(spark):
    """Whole ranges stay arrays; at most six rows of each become rows, and all windows come after that."""
    df = spark.createDataFrame([(f"T{i}", *v) for i in range(4) for v in walk(251, i)], BARS)
    rows = analysis.signals(df, ENDS)
    nodes = [line.strip(" :+-") for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    spread = next(i for i, n in enumerate(nodes) if n.startswith("Generate posexplode"))
    windows = [i for i, n in enumerate(nodes) if n.startswith("Window ")]
    assert windows and max(windows) < spread
    from panelwright.operators import align, indicators

    assert indicators.last_of_ranges(align.ranged(df, ENDS)).count() <= 6 * 8
