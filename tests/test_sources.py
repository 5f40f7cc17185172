"""Sources, sectors, exports and streaming."""

import base64
import datetime as dt
import logging
import os
import re

import pytest
from pyspark.sql import functions as F

from panelwright.plans import analysis
from panelwright.plans import queries as q
from panelwright.sinks import exports
from panelwright import logs
from panelwright.sources import bars, sectors, store, universe
from panelwright.streaming import bars as streaming


def test_universes(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), (None, 2), (" ", 3), ("B ", 4), ("A", 5)], "symbol string, x int")
    assert [tuple(r) for r in universe.tickers(df, ["x"]).orderBy("seq").collect()] == [(0, "A.NS"), (1, "B .NS"), (2, "A.NS")]
    with pytest.raises(universe.UniverseError):
        universe.tickers(df.select("x"))
    with pytest.raises(universe.UniverseError):
        universe.require(universe.empty(spark))
    (tmp_path / "ind_nifty50list.csv").write_text("Company,Symbol\nx,RELIANCE\ny,TCS\n")
    got = universe.resolve(spark, "Index Constituents", "NIFTY 50", f"{tmp_path}/")
    assert [r.ticker for r in got.orderBy("seq").collect()] == ["RELIANCE.NS", "TCS.NS"]
    with pytest.raises(universe.UniverseError):
        universe.index_path("NIFTY 51")
    assert universe.catalog(spark).count() == 16


def test_date_range_reaches_the_scan(spark, tmp_path):
    rows = [("A", dt.date(2000, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, float("nan") if i == 399 else 1.0, 1.0) for i in range(500)]
    path = str(tmp_path / "bars")
    spark.createDataFrame(rows, "ticker string, bar_date date, open double, high double, low double, close double, volume double").write.parquet(path)
    df = bars.scan(spark, path, "2001-02-03")
    assert df.count() == 251 and df.where("close is null").count() == 1
    assert "GreaterThanOrEqual(bar_date" in df._jdf.queryExecution().executedPlan().toString()
    assert bars.scan(spark, path, "2001-02-03", spark.createDataFrame([(0, "B")], "seq long, ticker string")).count() == 0
    several = bars.in_range(df, ["2001-02-03", "2000-12-31"])
    assert {r.as_of.isoformat(): r["count"] for r in several.groupBy("as_of").count().collect()} == {"2001-02-03": 251, "2000-12-31": 217}


def test_layouts(spark):
    wide = spark.createDataFrame([(dt.date(2000, 1, 1), 1.0, 2.0)], "bar_date date, `A|close` double, `B|close` double")
    assert {(r.ticker, r.close, r.open) for r in bars.from_wide(wide).collect()} == {("A", 1.0, None), ("B", 2.0, None)}
    one = bars.from_wide(wide).where("ticker = 'A'").drop("ticker")
    assert bars.from_frames({"X": one, "Y": one}).count() == 2
    assert bars.with_closes(bars.from_wide(wide).withColumn("close", F.when(F.col("ticker") == "A", F.col("close")))).count() == 1
    with pytest.raises(ValueError, match="future"):
        bars.not_after(dt.date(2100, 1, 1))


def test_sector_table_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/sectors"
    assert sectors.load(spark, path).count() == 0
    uni = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "D")], "seq long, ticker string")
    source = spark.createDataFrame([("A", "x"), ("B", ""), ("C", None)], "ticker string, sector string")
    sectors.store(spark.createDataFrame([("A", "old")], "ticker string, sector string"), path)
    sectors.store(sectors.refresh(uni, sectors.load(spark, path), source), path)
    assert {r.ticker: r.sector for r in sectors.load(spark, path).collect()} == {"A": "old", "B": "Other", "C": "Other", "D": "Other"}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', "x,y"), (0, None, "é\nz")], "pos int, t string, u string")
    text = base64.b64decode(exports.csv_base64(df, "pos").collect()[0][0]).decode()
    assert text == 't,u\n,"é\nz"\n"a""b","x,y"\n'
    link = spark.range(1).select(exports.link(F.lit("QQ=="), "f.csv").alias("l")).collect()[0].l
    assert 'download="f.csv"' in link and "base64,QQ==" in link
    assert exports.export_name("ILFO", dt.date(2001, 6, 30), "all_long") == "ILFO_2001-06-30_all_long.csv"
    exports.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2
    assert exports.html_table(df.select("pos").orderBy("pos")).count("<td>") == 2


def test_streamed_bars_are_batch_bars(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_bars(streaming.read_events(spark, str(tmp_path / "in"), events.schema), late="5000 days")
    assert stream.isStreaming
    query = streaming.write_bars(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert query.exception() is None
    live = streaming.stream_bars(streaming.read_events(spark, str(tmp_path / "in"), events.schema), late="1 day")
    memory = live.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    memory.awaitTermination(60)
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, streaming.stream_bars(events).collect()))


def test_analysis(spark, sf):
    done = analysis.run(q.all_tickers(spark, sf), q.all_bars(spark, sf), q.stored_sectors(spark, sf), q.FLAGSHIP)
    assert done.results.count() == 10 and done.missing_count == 0
    assert sum(r.n for r in done.counts.collect()) == 10
    assert done.metrics.collect()[0].analysed == 10 and sum(r.Total for r in done.by_sector.collect()) == 10
    assert done.longs.count() + done.shorts.count() + done.errors.count() <= 10


def test_signals_scan_the_range_of_stored_bars(spark, sf):
    """Of the query itself: no trades are read again, the date range reaches the scan, two exchanges by hash."""
    plan = q.signal_asof(spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and not any("lineitem" in x or "l_" in x for x in scans) and all("panelwright-bars" in x for x in scans)
    assert all("GreaterThanOrEqual(bar_date,2000-10-23)" in x and "LessThanOrEqual(bar_date,2001-06-30)" in x for x in scans), plan
    # the calendar's scan reads dates only
    assert len(scans) == 2 and any(re.search(r"ReadSchema: struct<bar_date:date>", x) for x in scans)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2, plan


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    made = []
    make = lambda: made.append(1) or spark.read.parquet(source)
    first = store.once(spark, "t", [source], make)
    assert store.once(spark, "t", [source], make) == first and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    second = store.once(spark, "t", [source], make)
    assert second != first and spark.read.parquet(second).count() == 5
    path = second.removeprefix("file:").replace("///", "/")
    os.rename(path, path + ".away")
    assert spark.read.parquet(store.once(spark, "t", [source], make)).count() == 5 and len(made) == 3


def test_text_that_is_no_number_is_an_error_of_its_ticker(spark, tmp_path):
    day = dt.date(2001, 6, 30)
    lines = ["ticker,bar_date,open,high,low,close,volume"]
    for t in ("A", "B", "C"):
        for i in range(60 if t != "C" else 20):
            close = "n/a" if t in "BC" and i == 7 else "" if i == 3 else "10.5"
            lines.append(f"{t},{day - dt.timedelta(days=i)},10,11,9,{close},100")
    (tmp_path / "bars.csv").write_text("\n".join(lines))
    rows = bars.scan(spark, f"{tmp_path}/bars.csv", day)
    assert rows.where("fault is not null").count() == 2
    out = {r.ticker: r for r in analysis.signals(rows, day, "own").collect()}
    assert (out["B"].signal, out["B"].details, out["B"].confidence_grade) == ("Error (Calc)", "close is not a number: n/a", "D")
    assert out["A"].signal == "Neutral" and out["C"].signal == "Insufficient Data"
    assert out["B"].vol_surge is None and out["B"].pct_change is None


def test_many_as_of_dates_are_joined(spark, monkeypatch):
    days = [(f"T{k}", dt.date(2000, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(2) for i in range(0, 300, 7)]
    df = spark.createDataFrame(days, "ticker string, bar_date date, open double, high double, low double, close double, volume double")
    dates = [dt.date(2000, 3, 1) + dt.timedelta(days=9 * i) for i in range(12)]
    want = sorted((r.as_of, r.ticker, r.bar_date) for r in bars.in_range(df, dates).collect())
    monkeypatch.setattr(bars, "DATES", 3)
    assert sorted((r.as_of, r.ticker, r.bar_date) for r in bars.in_range(df, dates).collect()) == want
    monkeypatch.setattr(bars, "PAIRS", 3)
    assert sorted((r.as_of, r.ticker, r.bar_date) for r in bars.in_range(df, dates).collect()) == want


def test_html_reports_escape_and_have_any_length(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("A<&", "<b>x</b>", None), ("B", "y", "it's")], "ticker string, signal string, sector string")
    text = exports.html_table(df)
    assert "<td>A&lt;&amp;</td><td><b>x</b></td><td></td>" in text and "it&#x27;s" in text
    monkeypatch.setattr(exports, "RENDERED", 1)
    with pytest.raises(ValueError, match="write_html"):
        exports.html_table(df)
    head, foot = exports.write_html(df, str(tmp_path / "html"))
    body = "".join(r.value for r in spark.read.text(str(tmp_path / "html")).collect())
    assert body.count("<tr>") == 2 and head + body + foot == text or set(body.split("</tr>")) == set(text.removeprefix(head).removesuffix(foot).split("</tr>"))


def test_log_lines(spark, caplog):
    with caplog.at_level(logging.INFO, "panelwright"):
        with logs.progress(spark, "count", every=0.01):
            spark.range(1000).repartition(4).count()
        with pytest.raises(ZeroDivisionError), logs.progress(spark, "broken"):
            1 / 0  # noqa: B018
    text = caplog.text
    assert "count: started" in text and "tasks" in text and "count: done" in text and "broken: failed" in text


def test_a_task_is_dealt_a_bounded_number_of_trades_and_bars(spark, sf, monkeypatch):
    """However small a shuffle is, adaptive execution gathers no more rows in a task than those asked for."""
    from pyspark.sql import functions as F

    from panelwright.plans import queries as q
    from panelwright.sources import bars as bar_sources

    def tasks(df, *keys):
        return df.select(F.spark_partition_id().alias("p"), *keys).distinct().groupBy("p").count().count()

    # 10 suppliers with 6,000 trades
    monkeypatch.setattr(bar_sources, "TRADES", 200)
    monkeypatch.setattr(bar_sources, "DEALT", 200)
    trades = q.read(spark, sf, "lineitem")
    parts = bar_sources.tasks(trades, bar_sources.TRADES)
    assert parts == -(-trades.count() // 200) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bar_sources.tasks(trades, 10**9) == spark.sparkContext.defaultParallelism
    for df in (q.derived_bars(spark, sf), q.panel(spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # nothing is dealt once more by a shuffle whose tasks adaptive execution chooses
        assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM"), plan
        assert tasks(df, "ticker") > int(spark.conf.get("spark.sql.shuffle.partitions"))
