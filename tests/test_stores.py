"""Numbering and base64 in parts, snapshots, records by request, wide tables, observed runs."""

import base64
import datetime as dt
import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from panelwright.operators import numbering, report
from panelwright.plans import analysis
from panelwright.plans import queries as q
from panelwright.schema import BARS, FIELDS
from panelwright.sinks import exports
from panelwright.sources import bars, remote, sectors, universe
from panelwright.sources.snapshots import Conflict, Snapshots

SECTOR_ROWS = "ticker string, sector string"


def test_numbers_follow_the_order(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *"abc"]), i, r.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b int, c double").repartition(7)
    out = numbering.numbered(df, [F.desc_nulls_last("a"), "b"], "n", 5)
    want = sorted(rows, key=lambda x: (x[0] is None, -ord(x[0] or "a"), x[1]))
    assert [tuple(x) for x in out.orderBy("n").collect()] == [(*x, i + 5) for i, x in enumerate(want)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    sums = numbering.summed(df.withColumn("size", F.col("b") % 5), [F.desc_nulls_last("a"), "b"], "size", "before")
    at, expected = 0, {}
    for x in want:
        expected[x[1]] = at
        at += x[1] % 5
    assert {x.b: x.before for x in sums.collect()} == expected
    assert numbering.numbered(df.limit(0), ["b"], "n").count() == numbering.summed(df.limit(0), ["b"], "b", "s").count() == 0
    assert [x.n for x in numbering.numbered(spark.range(1), ["id"], "n").collect()] == [0]


def test_the_universe_and_positions_need_no_single_task(spark, sf):
    plan = q.universe_symbols(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    rows = spark.createDataFrame([(i, ["Long", "Neutral", "Divergence Short"][i % 3], float(i % 7)) for i in range(50)], "seq int, signal string, confidence double")
    numbered = report.positions(rows, "seq")
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    alone = report.positions(rows.withColumn("k", F.lit(1)), "seq", "k").drop("k")
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, alone.collect()))


@pytest.mark.parametrize("size", [3, 30, 3000])
def test_parts_of_base64_are_the_whole(spark, size):
    r = random.Random(size)
    rows = [(i, "".join(r.choice('aé€\U0001f600",\n') for _ in range(r.randrange(40))), None if i % 7 == 0 else i / 3) for i in range(150)]
    df = spark.createDataFrame(rows, "pos int, t string, `u,v` double").repartition(5)
    parts = exports.csv_base64_parts(df, "pos", size).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(len(parts)))
    assert all(len(p.csv_base64) == size // 3 * 4 for p in parts[:-1]) and 0 < len(parts[-1].csv_base64) <= size // 3 * 4
    assert "".join(p.csv_base64 for p in parts) == exports.csv_base64(df, "pos").collect()[0][0]
    assert base64.b64decode("".join(p.csv_base64 for p in parts)).decode().startswith("t,u,v\n")


def test_base64_of_nothing_and_odd_sizes(spark):
    empty = spark.createDataFrame([], "pos int, t string")
    assert [tuple(r) for r in exports.csv_base64_parts(empty, "pos").collect()] == [(0, base64.b64encode(b"t\n").decode())]
    for size in (0, 4, -3):
        with pytest.raises(ValueError, match="multiple of three"):
            exports.csv_base64_parts(empty, "pos", size)


def test_snapshots_are_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    s = Snapshots(spark, path)
    assert s.latest() == (0, None)
    assert s.replace(spark.range(3)) == 1 and spark.read.parquet(s.latest()[1]).count() == 3
    unfinished = s.write(spark.range(9))  # a driver lost before it publishes
    assert spark.read.parquet(s.latest()[1]).count() == 3
    assert s.publish(unfinished, 2) and not s.publish(s.write(spark.range(1)), 2)
    assert spark.read.parquet(s.latest()[1]).count() == 9
    reader = spark.read.parquet(s.latest()[1])
    for n in range(2):
        s.replace(spark.range(n))
    assert reader.count() == 9  # its snapshot is still there
    for n in range(4):
        s.replace(spark.range(n))
    assert s._numbers() == [6, 7, 8]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    Snapshots(spark, path).replace(spark.createDataFrame([("a",)], "k string"))
    inside = []

    def add(name, then=None):
        def make(old):
            rows = old.collect()
            if then and not inside:
                inside.append(1)
                then()  # the other writer publishes between this one's reading and its publishing
            return spark.createDataFrame([*map(tuple, rows), (name,)], "k string")

        return Snapshots(spark, path).change(make)

    assert add("b", lambda: add("c")) == 3
    assert sorted(r.k for r in spark.read.parquet(Snapshots(spark, path).latest()[1]).collect()) == ["a", "b", "c"]
    barrier, done = threading.Barrier(4), []

    def write(n):
        barrier.wait()
        done.append(Snapshots(spark, path).replace(spark.createDataFrame([(f"w{n}",)] * (n + 1), "k string")))

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [4, 5, 6, 7]
    last = [r.k for r in spark.read.parquet(Snapshots(spark, path).latest()[1]).collect()]
    assert last == [f"w{int(last[0][1:])}"] * (int(last[0][1:]) + 1)
    monkeypatch.setattr(Snapshots, "publish", lambda self, name, number: False)
    with pytest.raises(Conflict):
        Snapshots(spark, path).replace(spark.range(1))


def test_sectors_have_one_row_a_ticker(spark, tmp_path):
    path = f"{tmp_path}/sectors"
    source = spark.createDataFrame([("A", "z"), ("A", "y"), ("A", ""), ("B", None), ("B", ""), (None, "q")], SECTOR_ROWS)
    uni = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "A")], "seq long, ticker string")
    sectors.store_refreshed(uni, source, path)
    assert {r.ticker: r.sector for r in sectors.load(spark, path).collect()} == {"A": "y", "B": "Other", "C": "Other"}
    sectors.store_refreshed(spark.createDataFrame([(0, "D")], "seq long, ticker string"), source, path)
    assert sectors.load(spark, path).count() == 4
    assert sorted(map(tuple, sectors.with_sector(uni, sectors.load(spark, path)).select("seq", "sector").collect())) == [(0, "y"), (1, "Other"), (2, "Other"), (3, "y")]


@pytest.fixture
def store_of_sectors(spark, tmp_path):
    rows = [(f"T{i:03d}", f"s{i % 7}" if i % 5 else "") for i in range(100)] + [(None, "x"), ('T"1,', "quoted, too")]
    remote.write_store(spark.createDataFrame(rows, SECTOR_ROWS), f"file://{tmp_path}/store", "ticker", 6)
    return tmp_path / "store", {t: s or None for t, s in rows if t}


def test_records_by_request(spark, store_of_sectors):
    path, want = store_of_sectors
    df = remote.records(spark, f"file://{path}", SECTOR_ROWS, "ticker")
    assert {r.ticker: r.sector for r in df.collect()} == want
    few = remote.records(spark, str(path), SECTOR_ROWS, "ticker", first="T010", last="T012")
    assert few.rdd.getNumPartitions() < df.rdd.getNumPartitions() and {r.ticker for r in few.collect()} >= {"T010", "T011", "T012"}
    asked = spark.createDataFrame([(t,) for t in ("T001", "T005", "nobody")], "ticker string")
    assert {r.ticker: r.sector for r in sectors.look_up(asked, df).collect()} == {"T001": "s1", "T005": "Other", "nobody": "Other"}
    with pytest.raises(Exception, match="records are text"):
        remote.records(spark, str(path), "ticker string, n int", "ticker").collect()


def test_filters_reach_the_source(spark, store_of_sectors):
    path, want = store_of_sectors
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: remote.records(spark, str(path), SECTOR_ROWS, "ticker", push="true")
        for cond, keep in (("ticker = 'T050'", lambda t: t == "T050"), ("ticker in ('T001', 'T099', 'x')", lambda t: t in ("T001", "T099", "x")), ("ticker >= 'T090' and ticker < 'T095'", lambda t: "T090" <= t < "T095"), ("ticker > 'U' or sector = 's1'", lambda t: t > "U" or want[t] == "s1")):
            some = load().where(cond)
            assert {r.ticker for r in some.collect()} == {t for t in want if keep(t)}
        assert load().where("ticker = 'T050'").rdd.getNumPartitions() == 1 < load().rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = remote.FilteringReader(load().schema, {"url": str(path)})
    assert list(reader.pushFilters([remote.EqualTo(("ticker",), "T050"), remote.EqualTo(("sector",), "s1")])) and len(reader.wanted) == 1
    assert len(reader.partitions()) == 1 and len(remote.RecordReader(load().schema, {"url": str(path)}).partitions()) >= 5


class Shaky(http.server.SimpleHTTPRequestHandler):
    failures: dict = {}
    lost: set = set()

    def do_GET(self):  # noqa: N802
        name = self.path.rsplit("/", 1)[-1]
        if name in self.lost or self.failures.get(name, 0) > 0:
            self.failures[name] = self.failures.get(name, 0) - 1
            self.send_error(503)
        else:
            super().do_GET()

    def log_message(self, *args):
        pass


def test_failed_parts_are_asked_for_again(spark, store_of_sectors):
    path, want = store_of_sectors
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), lambda *a: Shaky(*a, directory=str(path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    names = [p.name for p in remote.RecordReader(spark.createDataFrame([], SECTOR_ROWS).schema, {"url": url}).partitions()]
    try:
        Shaky.failures = {n: 2 for n in [*names, "parts.csv"]}
        df = remote.records(spark, url, SECTOR_ROWS, "ticker", retries=2, pause=0.01)
        assert {r.ticker: r.sector for r in df.collect()} == want
        Shaky.lost = {names[0]}
        with pytest.raises(Exception, match="503"):
            remote.records(spark, url, SECTOR_ROWS, "ticker", retries=1, pause=0.01).collect()
        skipped = remote.records(spark, url, SECTOR_ROWS, "ticker", retries=1, pause=0.01, onfail="skip")
        left = {r.ticker for r in skipped.collect()}
        assert left < set(want) and left
        asked = spark.createDataFrame([(t,) for t in want], "ticker string")
        found = {r.ticker: r.sector for r in sectors.look_up(asked, skipped).collect()}
        assert found == {t: (s or "Other") if t in left else "Other" for t, s in want.items()}
    finally:
        Shaky.lost = set()
        server.shutdown()
    with pytest.raises(OSError, match="."):
        remote.fetch_again(f"{path}/absent.csv", 1, 1, 0.01)


def test_index_constituents_from_a_store(spark, tmp_path):
    remote.write_store(spark.createDataFrame([("x", "TCS"), ("y", " "), ("z", "INFY")], "Company string, Symbol string"), str(tmp_path / "idx"), "Company", 2)
    found = universe.tickers(remote.records(spark, str(tmp_path / "idx"), "Company string, Symbol string", "Company"), ["Company"])
    assert sorted(map(tuple, found.collect())) == [(0, "TCS.NS"), (1, "INFY.NS")]
    remote.write_store(spark.createDataFrame([], "Company string, Symbol string"), str(tmp_path / "none"), "Company", 2)
    assert remote.records(spark, str(tmp_path / "none"), "Company string, Symbol string", "Company").count() == 0


def test_wide_tables_of_thousands_of_tickers(spark):
    n, days = 2000, 3
    names = [f"T.{i}|{f}" for i in range(n) for f in (("close", "volume") if i % 2 else ("close",))]
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(days=d), *[float("nan") if d == 1 and i == 4 else float(i + d) for i in range(len(names))]) for d in range(days)]
    wide = spark.createDataFrame(rows, ", ".join(["bar_date date", *[f"`{c}` double" for c in names]]))
    out = bars.from_wide(wide)
    assert out.dtypes == spark.createDataFrame([], BARS).dtypes
    got = {(r.ticker, r.bar_date): r for r in out.collect()}
    assert len(got) == n * days
    at = {c: i for i, c in enumerate(names)}
    for i in (0, 1, 777, 1999):
        for d in range(days):
            r = got[f"T.{i}", rows[d][0]]
            for f in FIELDS:
                v = rows[d][1 + at[f"T.{i}|{f}"]] if f"T.{i}|{f}" in at else None
                assert r[f] == (None if v is None or v != v else v)
    # 150 tickers or 2: the same plan
    steps = [len(bars.from_wide(wide.select("bar_date", *[f"`{c}`" for c in names[:k]]))._jdf.queryExecution().optimizedPlan().toString().splitlines()) for k in (3, 225)]
    assert steps[0] == steps[1]
    assert bars.from_wide(wide.limit(0)).count() == 0


def test_a_kept_run_counts_as_it_writes(spark, sf):
    universe_ = q.all_tickers(spark, sf).union(spark.createDataFrame([(99, "nobody"), (100, "nobody")], "seq long, ticker string"))
    kept = analysis.run(universe_, q.all_bars(spark, sf), q.stored_sectors(spark, sf), q.FLAGSHIP)
    lazy = analysis.run(universe_, q.all_bars(spark, sf), q.stored_sectors(spark, sf), q.FLAGSHIP, keep=False)
    assert kept.seen == (11, 10) and kept.missing_count == lazy.missing_count == 1
    assert [r.ticker for r in kept.missing.collect()] == ["nobody"]
    plain = analysis.run(q.all_tickers(spark, sf), q.all_bars(spark, sf).where("ticker <> 'Supplier#000000003.NS'"), q.stored_sectors(spark, sf), q.FLAGSHIP)
    assert plain.seen == (10, 9) and plain.missing_count == 1 and plain.counts.where("bucket = 'Error'").first().n >= 1
    order = [r.ticker for r in lazy.results.collect()]
    assert [r.ticker for r in kept.results.collect()] == order and len(order) == 10
    plan = kept.results._jdf.queryExecution().executedPlan().toString()
    assert "panelwright-results" in plan and "Window" not in plan and "InMemoryTableScan" not in plan
    absent = analysis.run(universe_, q.all_bars(spark, sf), q.stored_sectors(spark, sf), q.FLAGSHIP, absent=True)
    assert absent.missing_count == 0 and absent.results.where("signal = 'No Data'").count() == 2
