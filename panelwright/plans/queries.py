"""The queries of the library over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import params
from panelwright.functions import scans
from panelwright.operators import align, display, indicators, report, scoring
from panelwright.operators import signals as sig
from panelwright.plans import analysis, oracle
from panelwright.schema import CRITERIA, FIELDS, UNIVERSE
from panelwright.sinks import exports
from panelwright.sources import bars as bar_sources
from panelwright.sources import sectors as sector_sources
from panelwright.sources import remote, store
from panelwright.sources import universe as universes
from panelwright.sources.actions import adjusted
from panelwright.streaming import bars as streaming

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = ("2001-06-30",)
FLAGSHIP = "1998-09-01"
#: Quarter ends: several dates bring enough actionable rows for the reports.
MANY = tuple(f"{y}-{md}" for y in (1997, 1998, 1999) for md in ("03-31", "09-30"))
EARLY = ("1995-02-10",)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars made from the trades, in tasks of a bounded number of trades."""
    trades = read(spark, sf_dir, "lineitem")
    return bar_sources.from_trades(trades, read(spark, sf_dir, "supplier"), universes.SUFFIX, bar_sources.tasks(trades, bar_sources.TRADES))


def bars_path(spark: SparkSession, sf_dir: str) -> str:
    """The table of bars, derived once; each of its files is sorted by date, so that a date range skips most of it."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier")]
    return store.once(spark, "bars", inputs, lambda: derived_bars(spark, sf_dir).sortWithinPartitions("bar_date", "ticker"))


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(bars_path(spark, sf_dir))


def bars_for(spark: SparkSession, sf_dir: str, as_ofs, universe: DataFrame | None = None) -> DataFrame:
    """Bars of the as-of dates' range; the range reaches the scan."""
    return bar_sources.scan(spark, bars_path(spark, sf_dir), as_ofs, universe)


def dealt_bars(spark: SparkSession, sf_dir: str, as_ofs) -> DataFrame:
    """``bars_for``, dealt by ticker to tasks of a bounded number of bars: that shuffle serves the panel, and the dates of its calendar pass it too."""
    return bars_for(spark, sf_dir, as_ofs).repartition(bar_sources.tasks(all_bars(spark, sf_dir), bar_sources.DEALT), "ticker")


def derived_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and dividends made from the largest trades."""
    t = read(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    split = (F.col("l_quantity") == 50) & (F.col("l_discount") >= 0.08)
    return t.select(
        F.concat("s_name", F.lit(universes.SUFFIX)).alias("ticker"),
        F.to_date("l_shipdate").alias("action_date"),
        F.when(split, 1.0 + F.col("l_linenumber") / 4).alias("ratio"),
        F.when(~split, F.col("l_tax") * 20).alias("dividend"),
    )


def all_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe of all suppliers, numbered once a session."""
    make = lambda: universes.tickers(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("SYMBOL")), ["s_suppkey"])
    return spark.read.schema(UNIVERSE).parquet(store.once(spark, "universe", [f"{sf_dir}/supplier.parquet"], make))


def stored_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors of the suppliers of four nations in five; the others are yet to be looked up."""
    s = read(spark, sf_dir, "supplier").where("s_nationkey % 5 <> 0").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.concat("s_name", F.lit(universes.SUFFIX)).alias("ticker"), F.col("n_name").alias("sector"))


def sector_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of sectors, some of them empty."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.concat("s_name", F.lit(universes.SUFFIX)).alias("ticker"), F.when(F.col("s_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("sector"))


def panel(spark: SparkSession, sf_dir: str, as_ofs=AS_OF, how: str = "union") -> DataFrame:
    return analysis.panel(dealt_bars(spark, sf_dir, as_ofs), as_ofs, how)


def last_signals(spark: SparkSession, sf_dir: str, as_ofs=AS_OF) -> DataFrame:
    return analysis.flow_signals(dealt_bars(spark, sf_dir, as_ofs), as_ofs)


def records(spark: SparkSession, sf_dir: str, as_ofs=MANY) -> DataFrame:
    """Results of every as-of date, with sector and universe order."""
    scored = analysis.signals(dealt_bars(spark, sf_dir, as_ofs), as_ofs).join(all_tickers(spark, sf_dir), "ticker")
    return report.results(sector_sources.with_sector(scored, stored_sectors(spark, sf_dir)))


def r4(x, alias: str | None = None):
    """To four decimals by the same arithmetic as the SQL; the half is nudged, so that values a rounding error below a tie agree."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.floor(c * 10000.0 + 0.500001).cast("double") / 10000.0).alias(alias or x)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources


@query(f"with {oracle.UNIVERSE} select seq, ticker from universe")
def universe_symbols(spark, sf_dir):
    return universes.require(all_tickers(spark, sf_dir))


@query(f"select index_name, path, count(s_suppkey) as n from {oracle.INDICES} left join supplier on index_name = ({oracle.INDEX_NAMES})[s_suppkey % 16 + 1] and trim(s_name) <> '' group by all")
def index_catalog(spark, sf_dir):
    """All indices with the number of their constituents, the suppliers dealt to them in turn."""
    names = F.array(*[F.lit(n) for n in universes.INDEX_FILES])
    dealt = read(spark, sf_dir, "supplier").where("trim(s_name) <> ''").groupBy(F.get(names, (F.col("s_suppkey") % 16).cast("int")).alias("index_name")).agg(F.count(F.lit(1)).alias("n"))
    return universes.catalog(spark).join(dealt, "index_name", "left").select("index_name", "path", F.coalesce("n", F.lit(0)).alias("n"))


@query("""select case s_nationkey % 3 when 0 then 'NIFTY 50' when 1 then 'NIFTY BANK' else 'NIFTY IT' end as index_name, trim(s_name) || '.NS' as ticker
from supplier where s_suppkey % 11 <> 0""")
def index_constituents(spark, sf_dir):
    """The constituents of three indices, each read from its CSV file with a header; some symbols are blank or absent."""
    names = ("NIFTY 50", "NIFTY BANK", "NIFTY IT")

    def files(root: str) -> None:
        blank = F.when(F.col("s_suppkey") % 22 == 0, "  ").when(F.col("s_suppkey") % 11 != 0, F.col("s_name"))
        for i, name in enumerate(names):
            mine = read(spark, sf_dir, "supplier").where(F.col("s_nationkey") % 3 == i)
            path = universes.index_path(name, f"{root}/")
            mine.select(F.concat(F.lit("Company, "), "s_name").alias("Company Name"), blank.alias("Symbol"), F.lit("EQ").alias("Series")).write.option("header", True).csv(path)

    root = store.once(spark, "indices", [f"{sf_dir}/supplier.parquet"], files)
    found = [universes.resolve(spark, universes.KINDS[1], n, f"{root}/").select(F.lit(n).alias("index_name"), "ticker") for n in names]
    return reduce(DataFrame.union, found)


@query(f"""with {oracle.BARS}, n as (select n_name, bar_date, avg(close) as close, sum(volume) as volume from bars join supplier on ticker = s_name || '.NS' join nation on n_nationkey = s_nationkey group by all),
days as (select distinct bar_date from bars)
select n_name as ticker, bar_date, null::double as open, null::double as high, null::double as low, {oracle.r4('close')}, {oracle.r4('volume')} from (select n_name from nation) cross join days left join n using (n_name, bar_date)""")
def bars_of_wide_table(spark, sf_dir):
    """Mean closes and volumes of nations: a wide table with two columns for each, made long again."""
    where = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    bars = all_bars(spark, sf_dir).join(where.select(F.concat("s_name", F.lit(universes.SUFFIX)).alias("ticker"), "n_name"), "ticker")
    names = sorted(r.n_name for r in read(spark, sf_dir, "nation").select("n_name").distinct().collect())  # 25 rows at any scale
    wide = bars.groupBy("bar_date").pivot("n_name", names).agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    wide = wide.toDF("bar_date", *[f"{n}|{f}" for n in names for f in ("close", "volume")])
    return bar_sources.from_wide(wide).select("ticker", "bar_date", "open", "high", "low", r4("close"), r4("volume"))


@query(f"""with {oracle.BARS} select r_name as ticker, bar_date, {oracle.r4('min(open)', 'open')}, {oracle.r4('max(high)', 'high')}, {oracle.r4('min(low)', 'low')}, {oracle.r4('max(close)', 'close')}, {oracle.r4('sum(volume)', 'volume')}
from bars join supplier on ticker = s_name || '.NS' join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by r_name, bar_date""")
def bars_of_frames(spark, sf_dir):
    """Bars of regions, of one table for each."""
    where = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    bars = all_bars(spark, sf_dir).join(where.select(F.concat("s_name", F.lit(universes.SUFFIX)).alias("ticker"), "r_name"), "ticker")
    days = bars.groupBy("r_name", "bar_date").agg(F.min("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"), F.sum("volume").alias("volume"))
    frames = {r.r_name: days.where(F.col("r_name") == r.r_name) for r in read(spark, sf_dir, "region").select("r_name").collect()}  # 5 rows at any scale
    return bar_sources.from_frames(frames).select("ticker", "bar_date", *map(r4, FIELDS))


@query(f"with {oracle.BARS} select * from bars")
def bars_daily(spark, sf_dir):
    return derived_bars(spark, sf_dir)


@query(f"with {oracle.BARS}, {oracle.SECTORS} select * from bars where bar_date between date '1997-03-31' - 250 and date '1999-09-30' and ticker in (select ticker from sectors)")
def bars_scan(spark, sf_dir):
    """The stored bars of a universe and a range of dates, both ends included."""
    return bars_for(spark, sf_dir, MANY, stored_sectors(spark, sf_dir))


_ADJUSTED_SQL = ", ".join(map(oracle.r4, FIELDS))


@query(f"with {oracle.ADJUSTED_BARS} select ticker, bar_date, {_ADJUSTED_SQL} from bars")
def bars_adjusted(spark, sf_dir):
    """All bars, adjusted for splits and dividends."""
    return adjusted(all_bars(spark, sf_dir), derived_actions(spark, sf_dir)).select("ticker", "bar_date", *map(r4, FIELDS))


@query(oracle.panel_sql(MANY, "select as_of, ticker, count(*) as n, max(bar_date) as bar_date, arg_max(close, bar_date) as close from ranged group by as_of, ticker", through="aligned"))
def bars_range_asof(spark, sf_dir):
    ranged = bar_sources.in_range(bars_for(spark, sf_dir, MANY), MANY)
    return ranged.groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("n"), F.max("bar_date").alias("bar_date"), F.max_by("close", "bar_date").alias("close"))


@query("select event_type as ticker, date_trunc('day', ts) as bar_start, arg_min(value, struct_pack(ts := ts, v := value)) as open, max(value) as high, min(value) as low, arg_max(value, struct_pack(ts := ts, v := value)) as close, count(*)::double as volume from events where value is not null and ts is not null group by all")
def event_bars(spark, sf_dir):
    """The streaming bar builder over a finished table."""
    return streaming.stream_bars(read(spark, sf_dir, "events")).withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- alignment and guards


@query(oracle.panel_sql(AS_OF, "select * from aligned", through="aligned"))
def calendar_align(spark, sf_dir):
    return align.aligned(dealt_bars(spark, sf_dir, AS_OF), AS_OF).drop("fault")


@query(oracle.panel_sql(AS_OF, "select as_of, ticker, bar_date, open, high, low, close, volume from guarded", through="guarded"))
def fill_ffill_bfill(spark, sf_dir):
    return panel(spark, sf_dir).select("as_of", "ticker", "bar_date", *FIELDS)


@query(oracle.panel_sql(("1995-03-20", *AS_OF), "select as_of, ticker, any_value(status) as status, any_value(status_details) as status_details, count(*) as n from guarded group by all", "own", "guarded").replace("group by all having", "group by as_of, ticker having").replace("from guarded group by all", "from guarded group by as_of, ticker"))
def ticker_status(spark, sf_dir):
    rows = panel(spark, sf_dir, ("1995-03-20", *AS_OF), "own")
    return rows.groupBy("as_of", "ticker").agg(F.any_value("status").alias("status"), F.any_value("status_details").alias("status_details"), F.count(F.lit(1)).alias("n"))


@query(oracle.panel_sql(AS_OF, "select as_of, ticker, any_value(status) as status, any_value(status_details) as status_details, count(*) as n, min(volume) as least, max(volume) as most from guarded group by as_of, ticker", "own", "guarded").replace(oracle.BARS, oracle.ODD_BARS))
def guards_of_odd_rows(spark, sf_dir):
    """Tickers without volumes, with a close of zero, with few rows, with volumes below one, without any close."""
    kind, day = F.substring("ticker", 10, 9).cast("int") % 6, F.dayofmonth("bar_date")
    odd = bars_for(spark, sf_dir, AS_OF).where((kind != 3) | (F.col("bar_date") > F.lit("2001-05-31").cast("date")))
    odd = odd.withColumns({
        "close": F.when((kind == 2) & (day == 15), 0.0).when(kind != 5, F.col("close")),
        "volume": F.when(kind == 4, (day % 3 - 1).cast("double")).when(kind != 1, F.col("volume")),
    })
    rows = analysis.panel(odd, AS_OF, "own")
    return rows.groupBy("as_of", "ticker").agg(F.any_value("status").alias("status"), F.any_value("status_details").alias("status_details"), F.count(F.lit(1)).alias("n"), F.min("volume").alias("least"), F.max("volume").alias("most"))


# ---------------------------------------------------------------- indicators: every row of the panel


def _indicator(name: str, through: str, floats: tuple[str, ...], others: tuple[str, ...] = ()) -> None:
    sql = oracle.panel_sql(AS_OF, f"select ticker, bar_date, {', '.join([*map(oracle.r4, floats), *others])} from masks", through="masks")

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return indicators.computed(panel(spark, sf_dir), through).select("ticker", "bar_date", *map(r4, floats), *others)

    f.__name__ = name
    query(sql)(f)


_indicator("sma_close_21", "raw_windows", ("c_sma",))
_indicator("stdev_close_21", "raw_windows", ("c_sd", "c_sd_all"))
_indicator("volume_mean_fallback", "raw_windows", ("volume_mean", "v_sd"))
_indicator("lag_diff_returns", "liquidity_and_flow", ("prev_close", "old_close", "velocity", "velocity_diff", "pct_change"))
_indicator("body_conviction", "body_conviction", ("body", "body_conviction", "direction_conviction"))
_indicator("volume_surge", "volume_surge", ("volume_z", "vol_surge", "volume_direction"))
_indicator("money_flow", "liquidity_and_flow", ("money_flow", "positive_flow", "negative_flow", "accumulation", "volume_score"))
_indicator("liquidity_normalized", "normalised", ("spread", "vwap_spread", "price_impact", "liquidity", "normalized_liq"))
_indicator("wilder_rsi", "normalised", ("momentum_rsi",))
@query("""with recursive v as (
  select event_type, ts::date as day, row_number() over (partition by event_type order by ts, event_id) as r, value - 50 as x from events where value is not null and ts is not null and event_type is not null),
steps as (
  select event_type, day, r, greatest(x, 0)::double as up, greatest(-x, 0)::double as down from v where r = 1
  union all select v.event_type, v.day, v.r, s.up * 8 / 9 + greatest(x, 0), s.down * 8 / 9 + greatest(-x, 0) from steps s join v on v.event_type = s.event_type and v.r = s.r + 1)
select event_type, day, n, """ + oracle.r4("rsi") + """ from (
  select event_type, day, r as n, case when r >= 9 and up + down > 0 then up * 100 / (up + down) end as rsi
  from steps qualify row_number() over (partition by event_type, day order by r desc) = 1)""")
def rsi_of_event_values(spark, sf_dir):
    """The strength of values above 50 against those below, averaged over all events of a type, at each day's last one; days are the blocks of the scan."""
    v = read(spark, sf_dir, "events").where("value is not null and ts is not null and event_type is not null")
    v = v.select("event_type", "ts", "event_id", F.to_date("ts").alias("day"), F.greatest(F.col("value") - 50, F.lit(0.0)).alias("gain"), F.greatest(50 - F.col("value"), F.lit(0.0)).alias("loss"))
    s = scans.decayed_by_blocks(v, ("event_type",), "day", ("ts", "event_id"), 8 / 9, {"up": "gain", "down": "loss"}, "n")
    last = s.groupBy("event_type", "day").agg(F.max(F.struct("n", "up", "down")).alias("s"))
    rsi = F.when(F.col("s.n") >= 9, F.try_divide(F.col("s.up") * 100, F.col("s.up") + F.col("s.down")))
    return last.select("event_type", "day", "s.n", r4(rsi, "rsi"))


_indicator("bands_breakout", "bands", ("upper_band", "lower_band"), ("overbought", "oversold"))
_indicator("oscillator", "acceleration_and_last_pivots", ("raw_score", "ilfo_value", "osc_momentum", "osc_accel", "signal_line"))
_indicator("pivots", "momentum_and_pivots", ("low_around", "high_around"), ("pivot_low", "pivot_high"))
_indicator("last_pivot", "acceleration_and_last_pivots", ("last_low", "last_low_osc", "last_high", "last_high_osc"))
_indicator("divergence", "masks", (), ("bull_div", "bear_div"))
_indicator("extremes", "masks", (), ("x_long", "x_short"))


# ---------------------------------------------------------------- signals and scores

_SIGNAL_SQL = f"select as_of, ticker, bar_date, signal, status_details, {oracle.r4('pct_change')}, {', '.join(map(oracle.r4, CRITERIA))} from classified"


def _signal(spark, sf_dir, as_ofs):
    rows = last_signals(spark, sf_dir, as_ofs)
    return rows.select("as_of", "ticker", "bar_date", "signal", "status_details", r4("pct_change"), *map(r4, CRITERIA))


@query(oracle.panel_sql(AS_OF, _SIGNAL_SQL))
def signal_asof(spark, sf_dir):
    return _signal(spark, sf_dir, AS_OF)


@query(oracle.panel_sql(AS_OF, _SIGNAL_SQL).replace(oracle.BARS, oracle.ADJUSTED_BARS))
def signal_of_adjusted_bars(spark, sf_dir):
    rows = analysis.flow_signals(adjusted(all_bars(spark, sf_dir), derived_actions(spark, sf_dir)), AS_OF)
    return rows.select("as_of", "ticker", "bar_date", "signal", "status_details", r4("pct_change"), *map(r4, CRITERIA))


@query(oracle.panel_sql(AS_OF, f"""select as_of, ticker, bar_date, case when text is null then signal else 'Error (Calc)' end as signal, coalesce(text, status_details) as status_details,
  {', '.join(oracle.r4(f'case when text is null then {c} end', c) for c in ('pct_change', *CRITERIA))} from classified left join faults using (as_of, ticker)""").replace(oracle.BARS, oracle.FAULTY_BARS).replace("classified as (", oracle.FAULTS + ",\nclassified as (", 1))
def faults_confined(spark, sf_dir):
    """Repeated bars, text that is no number and dates that can't be read make errors of their tickers; the others are as ever."""
    kind, day = F.substring("ticker", 10, 9).cast("int") % 7, F.dayofmonth("bar_date")
    bars = all_bars(spark, sf_dir).withColumns({"kind": kind, "day": day})
    text = F.col("bar_date").cast("string")
    raw = bars.withColumns({
        "bar_date": F.when((kind == 3) & (F.col("day") == 20), F.concat(text, F.lit("?"))).otherwise(text),
        "volume": F.when((kind == 2) & (F.col("day") == 15), "n/a").otherwise(F.col("volume").cast("string")),
    })
    raw = raw.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when((F.col("kind") == 1) & (F.col("day") == 10), 2).otherwise(1))))
    rows = analysis.flow_signals(bar_sources.typed(raw.select("ticker", "bar_date", *FIELDS)), AS_OF)
    return rows.select("as_of", "ticker", "bar_date", "signal", "status_details", r4("pct_change"), *map(r4, CRITERIA))


@query(oracle.panel_sql(MANY, _SIGNAL_SQL))
def signal_multi_asof(spark, sf_dir):
    return _signal(spark, sf_dir, MANY)


def _confidence(side: str):
    sql = oracle.panel_sql(MANY, f"select as_of, ticker, {oracle.r4(oracle._score(side), 'confidence_score')} from classified where status_details is null")  # noqa: SLF001

    def f(spark, sf_dir):
        rows = last_signals(spark, sf_dir, MANY).where("status_details is null")
        return rows.select("as_of", "ticker", r4(scoring.score(F.lit(side)), "confidence_score"))

    f.__name__ = f"confidence_{side.lower()}"
    query(sql)(f)


for _side in params.SIDES:
    _confidence(_side)


@query(oracle.panel_sql(MANY, "select as_of, ticker, 0.0 as confidence_score from classified where status_details is null"))
def confidence_of_no_side(spark, sf_dir):
    """A side that the model doesn't know has the score 0."""
    rows = last_signals(spark, sf_dir, MANY).where("status_details is null")
    return rows.select("as_of", "ticker", r4(scoring.score(F.lit("Sideways")), "confidence_score"))

_PARTS_SQL = f"""{oracle.PARAMS},
vals as (select as_of, ticker, sides.side, struct_pack({', '.join(f'{c} := {c}' for c in CRITERIA)}) as s from classified, (values ('Long'), ('Short')) sides(side) where status_details is null),
near as (select v.as_of, v.ticker, p.*, val as value, greatest(0, 1 - abs(val - p.median) / p.spread) as proximity
  from (select as_of, ticker, side, s, unnest([{', '.join(f"struct_pack(p := '{c}', x := s.{c})" for c in CRITERIA)}, struct_pack(p := 'confidence_score', x := null::double), struct_pack(p := 'body_conviction', x := null::double)]) as u from vals) v
  join lateral (select v.u.p as param, v.u.x as val) l on true join params p on p.side = v.side and p.param = l.param),
parts as (select as_of, ticker, side, param, ord, value, case when value is null then null else proximity end as proximity,
  case when value is null then 'missing' when proximity = 0 then 'far_from_median' when proximity <= 0.5 then 'near_median' else 'optimal_proximity' end as status,
  case when value is null then 0.0 else proximity * weight * 100 end as contribution, weight * 100 as max_contribution, importance from near)"""


def _parts(spark, sf_dir):
    rows = last_signals(spark, sf_dir, AS_OF).where("status_details is null")
    return scoring.breakdown(rows.withColumn("side", F.explode(F.array(*map(F.lit, params.SIDES)))), ("as_of", "ticker"))


@query(oracle.panel_sql(AS_OF, f"select as_of, ticker, side, param, ord, status, importance, {', '.join(map(oracle.r4, ('value', 'proximity', 'contribution', 'max_contribution')))} from parts").replace("\nselect as_of, ticker, side, param", f",\n{_PARTS_SQL}\nselect as_of, ticker, side, param"))
def confidence_breakdown(spark, sf_dir):
    return _parts(spark, sf_dir).select("as_of", "ticker", "side", "param", "ord", "status", "importance", *map(r4, ("value", "proximity", "contribution", "max_contribution")))


@query(oracle.panel_sql(AS_OF, f"""select as_of, ticker, side, param, ord, case when param = 'vol_surge' then 'no_stats' else status end as status,
  {oracle.r4("case when param = 'vol_surge' then 0.0 else contribution end", 'contribution')}, {oracle.r4('max_contribution')} from parts""").replace("\nselect as_of, ticker, side, param", f",\n{_PARTS_SQL}\nselect as_of, ticker, side, param", 1))
def confidence_without_anchor(spark, sf_dir):
    """A parameter without a median adds to the maximum only."""
    rows = last_signals(spark, sf_dir, AS_OF).where("status_details is null")
    table = params.table(spark).withColumn("median", F.when(F.col("param") != "vol_surge", F.col("median")))
    parts = scoring.breakdown(rows.withColumn("side", F.explode(F.array(*map(F.lit, params.SIDES)))), ("as_of", "ticker"), table=table)
    return parts.select("as_of", "ticker", "side", "param", "ord", "status", r4("contribution"), r4("max_contribution"))


_SUMMARY_SQL = f"""select as_of, ticker, side, {oracle.r4('points')}, {oracle.r4('max_score')}, critical_hits, high_hits, bonus, {oracle.r4('least(points + bonus, 100) / max_score * 100', 'confidence_score')} from (
  select *, case when critical_hits >= 2 then 5.0 when critical_hits >= 1 and high_hits >= 2 then 3.0 else 0.0 end as bonus from (
    select as_of, ticker, side, sum(contribution) as points, sum(max_contribution) as max_score,
      count(*) filter (proximity > 0.5 and importance = 'critical') as critical_hits, count(*) filter (proximity > 0.5 and importance = 'high') as high_hits
    from parts group by as_of, ticker, side))"""


@query(oracle.panel_sql(AS_OF, _SUMMARY_SQL).replace(f"\n{_SUMMARY_SQL}", f",\n{_PARTS_SQL}\n{_SUMMARY_SQL}"))
def confidence_summary(spark, sf_dir):
    s = scoring.summary(_parts(spark, sf_dir), ("as_of", "ticker", "side"))
    return s.select("as_of", "ticker", "side", r4("points"), r4("max_score"), "critical_hits", "high_hits", "bonus", r4("confidence_score"))


@query(oracle.panel_sql(MANY, f"select as_of, ticker, signal, side, {oracle.r4('confidence_score')}, confidence_grade, confidence_class from scored"))
def confidence_grade(spark, sf_dir):
    return analysis.signals(dealt_bars(spark, sf_dir, MANY), MANY).select("as_of", "ticker", "signal", "side", r4("confidence_score"), "confidence_grade", "confidence_class")


@query(oracle.panel_sql(EARLY, f"select as_of, ticker, signal, details, confidence_grade, confidence_class, {oracle.r4('confidence_score')} from scored union all select date '1995-02-10', ticker, 'No Data', 'No data at 1995-02-10', 'D', 'poor', 0.0 from universe where ticker not in (select ticker from scored)"))
def no_data_records(spark, sf_dir):
    """Every ticker of the universe has a record; those without bars in the range have ``No Data``."""
    rows = sig.no_data(all_tickers(spark, sf_dir), analysis.signals(dealt_bars(spark, sf_dir, EARLY), EARLY), EARLY)
    return rows.select("as_of", "ticker", "signal", "details", "confidence_grade", "confidence_class", r4("confidence_score"))


# ---------------------------------------------------------------- sectors


@query(f"with {oracle.UNIVERSE}, {oracle.SECTORS} select ticker, seq, coalesce(sector, 'Other') as sector from universe left join sectors using (ticker)")
def sector_join_default(spark, sf_dir):
    return sector_sources.with_sector(all_tickers(spark, sf_dir), stored_sectors(spark, sf_dir))


@query(f"with {oracle.UNIVERSE}, {oracle.SECTORS} select ticker from universe where ticker not in (select ticker from sectors)")
def sector_delta(spark, sf_dir):
    return sector_sources.missing(all_tickers(spark, sf_dir), stored_sectors(spark, sf_dir))


@query("""select s_name || '.NS' as ticker, case when s_nationkey % 2 = 0 then n_name else 'Other' end as sector
from supplier join nation on n_nationkey = s_nationkey where s_name || '.NS' between 'Supplier#000000003' and 'Supplier#000000700' and s_nationkey % 5 = 0""")
def sectors_by_request(spark, sf_dir):
    """Sectors of a range of the missing tickers, asked of a store of records; what it doesn't have is ``Other``."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("supplier", "nation")]
    url = store.once(spark, "sector-store", inputs, lambda path: remote.write_store(sector_source(spark, sf_dir), path, "ticker", 8))
    first, last = "Supplier#000000003", "Supplier#000000700"
    asked = F.col("ticker").between(first, last)
    found = remote.records(spark, url, "ticker string, sector string", "ticker", first=first, last=last).where(asked)
    missing = sector_sources.missing(all_tickers(spark, sf_dir), stored_sectors(spark, sf_dir)).where(asked)
    return sector_sources.look_up(missing, found)


@query(f"""with {oracle.SECTORS} select s_name || '.NS' as ticker,
  coalesce(s.sector, case when s_nationkey % 2 = 0 then n_name else 'Other' end) as sector
from supplier join nation on n_nationkey = s_nationkey left join sectors s on s.ticker = s_name || '.NS'""")
def sector_upsert(spark, sf_dir):
    return sector_sources.refresh(all_tickers(spark, sf_dir), stored_sectors(spark, sf_dir), sector_source(spark, sf_dir))


@query(f"""with {oracle.SECTORS} select s_name || '.NS' as ticker,
  coalesce(s.sector, case when s_nationkey % 2 = 0 then n_name else 'Other' end) as sector
from supplier join nation on n_nationkey = s_nationkey left join sectors s on s.ticker = s_name || '.NS'""")
def sector_table_stored(spark, sf_dir):
    """The dimension as it is stored and read again: an absent table, a first one, and one with the missing tickers added."""

    def publish(path: str) -> None:
        sector_sources.store(sector_sources.upsert(sector_sources.load(spark, path), stored_sectors(spark, sf_dir)), path)
        sector_sources.store_refreshed(all_tickers(spark, sf_dir), sector_source(spark, sf_dir), path)

    inputs = [f"{sf_dir}/{t}.parquet" for t in ("supplier", "nation")]
    return sector_sources.load(spark, store.once(spark, "sector-table", inputs, publish))


# ---------------------------------------------------------------- reports

_BUCKETS_SQL = "(values " + ", ".join(f"({i}, '{b}')" for i, b in enumerate(oracle.BUCKETS)) + ") b(ord, bucket)"


@query(oracle.panel_sql(EARLY, f"select b.ord::int as ord, b.bucket, count(r.ticker) + case when b.bucket = 'Error' then (select count(*) from universe where ticker not in (select ticker from results)) else 0 end as n from {_BUCKETS_SQL} left join results r on r.bucket = b.bucket group by b.ord, b.bucket"))
def signal_counts_with_missing(spark, sf_dir):
    """The day's tickers without data are counted as errors; their number is a part of the same plan."""
    rows = records(spark, sf_dir, EARLY)
    gone = report.missing_tickers(all_tickers(spark, sf_dir), rows).agg(F.count(F.lit(1)).alias("missing"))
    return report.signal_counts(rows).join(F.broadcast(gone)).select("ord", "bucket", (F.col("n") + F.when(F.col("bucket") == "Error", F.col("missing")).otherwise(0)).alias("n"))


@query(oracle.panel_sql(MANY, f"select b.ord::int as ord, b.bucket, count(r.ticker) as n from {_BUCKETS_SQL} left join results r on r.bucket = b.bucket group by b.ord, b.bucket"))
def signal_counts(spark, sf_dir):
    return report.signal_counts(records(spark, sf_dir))


_COUNT = lambda names: "count(*) filter (bucket in (" + ", ".join(f"'{n}'" for n in names) + "))"
_PIVOT_SQL = (
    "select *, row_number() over (order by \"Total\" desc, sector = 'Other', sector)::int as pos from (select sector, "
    + ", ".join(f"{_COUNT([b])} as \"{b}\"" for b in oracle.BUCKETS)
    + f", count(*) as \"Total\", {_COUNT(oracle.LONG_SIGNALS)} as \"Total Long\", {_COUNT(oracle.SHORT_SIGNALS)} as \"Total Short\" from results group by sector)"
)


@query(oracle.panel_sql(MANY, _PIVOT_SQL))
def sector_pivot(spark, sf_dir):
    return report.sector_pivot(records(spark, sf_dir))


@query(oracle.panel_sql(MANY, f"select * exclude (pos, \"Error\") from ({_PIVOT_SQL})"))
def sector_display(spark, sf_dir):
    return report.sector_display(report.sector_pivot(records(spark, sf_dir)))


@query(oracle.panel_sql(MANY, f"select sector, series, n from (unpivot (select sector, {_COUNT(oracle.LONG_SIGNALS)} as \"Total Long\", {_COUNT(oracle.SHORT_SIGNALS)} as \"Total Short\", {_COUNT(['Neutral'])} as \"Neutral\" from results group by sector) on \"Total Long\", \"Total Short\", \"Neutral\" into name series value n)"))
def sector_chart(spark, sf_dir):
    return report.sector_chart(report.sector_pivot(records(spark, sf_dir)))


_METRICS_SQL = f"""select *, case when ratio > 1.2 then 'success' when ratio > 0.8 then 'neutral' else 'danger' end as ratio_class,
  case when ratio > 1.2 then 'Bullish' when ratio < 0.8 then 'Bearish' else 'Balanced' end as ratio_label,
  case when isinf(ratio) then '∞' else printf('%.2f', ratio) end as ratio_text from (
select total_long, total_short, total_neutral, total_error, case when total_short = 0 then 'inf'::double else total_long / total_short end as ratio from (
select {_COUNT(oracle.LONG_SIGNALS)} as total_long, {_COUNT(oracle.SHORT_SIGNALS)} as total_short, {_COUNT(['Neutral'])} as total_neutral, {_COUNT(['Error'])} as total_error from results))"""


@query(oracle.panel_sql(MANY, _METRICS_SQL.replace("total_error, case", "total_error, case").replace("else total_long / total_short end as ratio", "else round(total_long / total_short, 4) end as ratio")))
def ratio_metrics(spark, sf_dir):
    m = report.metrics(records(spark, sf_dir))
    return m.select("total_long", "total_short", "total_neutral", "total_error", r4("ratio"), "ratio_class", "ratio_label", "ratio_text")


@query(oracle.panel_sql(MANY, "select count(*) filter (confidence >= 80) as high_confidence, count(*) filter (confidence >= 60 and confidence < 80) as medium_confidence, count(*) filter (confidence > 0 and confidence < 60) as low_confidence from results"))
def confidence_buckets(spark, sf_dir):
    return report.metrics(records(spark, sf_dir)).select("high_confidence", "medium_confidence", "low_confidence")


@query(oracle.panel_sql(MANY, f"select {oracle.r4('coalesce(avg(confidence) filter (side = $$Long$$), 0)', 'avg_long_confidence')}, {oracle.r4('coalesce(avg(confidence) filter (side = $$Short$$), 0)', 'avg_short_confidence')} from results"))
def avg_confidence(spark, sf_dir):
    return report.metrics(records(spark, sf_dir)).select(r4("avg_long_confidence"), r4("avg_short_confidence"))


_N = lambda x, a: f"format('{{:,}}', {x}) as {a}"


@query(oracle.panel_sql(MANY, f"""select {_N('count(*)', 'analysed')}, {_N(_COUNT(oracle.LONG_SIGNALS), 'total_long')}, {_N(_COUNT(oracle.SHORT_SIGNALS), 'total_short')}, {_N(_COUNT(['Neutral']), 'total_neutral')}, {_N(_COUNT(['Error']), 'total_error')},
  {_N('count(*) filter (confidence >= 80)', 'high_confidence')}, {_N('count(*) filter (confidence >= 60 and confidence < 80)', 'medium_confidence')}, {_N('count(*) filter (confidence > 0 and confidence < 60)', 'low_confidence')},
  printf('%.1f', coalesce(avg(confidence) filter (side = $$Long$$), 0)) as avg_long_confidence, printf('%.1f', coalesce(avg(confidence) filter (side = $$Short$$), 0)) as avg_short_confidence,
  case when {_COUNT(oracle.SHORT_SIGNALS)} = 0 then '∞' else printf('%.2f', {_COUNT(oracle.LONG_SIGNALS)} / {_COUNT(oracle.SHORT_SIGNALS)}) end as ratio_text,
  case when {_COUNT(oracle.SHORT_SIGNALS)} = 0 or {_COUNT(oracle.LONG_SIGNALS)} > 1.2 * {_COUNT(oracle.SHORT_SIGNALS)} then 'Bullish' when {_COUNT(oracle.LONG_SIGNALS)} < 0.8 * {_COUNT(oracle.SHORT_SIGNALS)} then 'Bearish' else 'Balanced' end as ratio_label from results"""))
def metric_cards(spark, sf_dir):
    return report.cards(report.metrics(records(spark, sf_dir)))


@query(oracle.panel_sql(EARLY, """select 'Long' as tab, count(*) as n, case when count(*) = 0 then 'No long signals generated for this analysis period.' end as note from results where contains(signal, 'Long')
union all select 'Short', count(*), case when count(*) = 0 then 'No short signals generated for this analysis period.' end from results where contains(signal, 'Short')
union all select 'Errors', count(*), case when count(*) = 0 then '✅ No errors encountered during analysis!' else '⚠️ ' || count(*) || ' stocks encountered errors during analysis.' end from results where bucket = 'Error'"""))
def report_notes(spark, sf_dir):
    """What the tabs of a report say where they are empty, and of errors."""
    return report.notes(records(spark, sf_dir, EARLY))


_ROW = ("as_of", "seq", "ticker", "sector", "signal", "grade", "confidence_class")
_ROW_FLOATS = ("pct_change", "confidence", *CRITERIA)
_ROW_SQL = f"{', '.join(_ROW)}, {', '.join(map(oracle.r4, _ROW_FLOATS))}"
_RANK_SQL = "floor(confidence * 1000000.0 + 0.500001)"
_POS_SQL = f"row_number() over (partition by as_of order by side is not null desc, case when side is not null then {_RANK_SQL} end desc nulls last, seq)::int as pos"


def _row(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*_ROW, *map(r4, _ROW_FLOATS), *more)


@query(oracle.panel_sql(MANY, f"select {_ROW_SQL}, {_POS_SQL} from results"))
def results_sorted(spark, sf_dir):
    return _row(report.positions(records(spark, sf_dir), "seq", "as_of"), "pos")


@query(oracle.panel_sql(MANY, f"select {_ROW_SQL} from results where side is not null qualify row_number() over (order by {_RANK_SQL} desc, as_of, seq) <= 10"))
def top_confidence(spark, sf_dir):
    rows = records(spark, sf_dir).where(sig.is_actionable())
    return _row(rows.orderBy(report.rank_confidence().desc(), "as_of", "seq").limit(10))


@query(oracle.panel_sql(MANY, f"select {_ROW_SQL} from results where contains(signal, 'Long')"))
def report_long(spark, sf_dir):
    return _row(report.longs(records(spark, sf_dir)))


@query(oracle.panel_sql(MANY, f"select {_ROW_SQL} from results where contains(signal, 'Short')"))
def report_short(spark, sf_dir):
    return _row(report.shorts(records(spark, sf_dir)))


@query(oracle.panel_sql(EARLY, f"select {_ROW_SQL} from results where bucket = 'Error'"))
def report_errors(spark, sf_dir):
    return _row(report.errors(records(spark, sf_dir, EARLY)))


@query(oracle.panel_sql(MANY, "select as_of, ticker, details from results"))
def details_text(spark, sf_dir):
    return records(spark, sf_dir).select("as_of", "ticker", "details")


def _cell_sql() -> str:
    css = oracle.SIGNAL_CLASS
    cell = lambda c, t: f"'<span class=\"' || {c} || '\">' || {t} || '</span>'"
    return f"""select as_of, ticker, {cell(f"({css})", 'signal')} as signal,
  case when pct_change is null then {cell("'pct-neutral'", "'N/A'")} when pct_change > 0 then {cell("'pct-positive'", "printf('+%.2f%%', pct_change)")}
    when pct_change < 0 then {cell("'pct-negative'", "printf('%.2f%%', pct_change)")} else {cell("'pct-neutral'", "printf('%.2f%%', pct_change)")} end as pct_change,
  case when coalesce(confidence, 0) = 0 then {cell("'pct-neutral'", "'N/A'")}
    else {cell("(case when confidence >= 80 then 'confidence-high' when confidence >= 60 then 'confidence-medium' else 'confidence-low' end)", "printf('%.1f%%', confidence)")} end as confidence,
  case when grade = 'N/A' then {cell("'signal-neutral'", "'N/A'")} else {cell("'grade-' || lower(replace(grade, '+', '-plus'))", 'grade')} end as grade from results"""


@query(oracle.panel_sql(MANY, _cell_sql()))
def display_cells(spark, sf_dir):
    return report.displayed(display.cells(records(spark, sf_dir))).select("as_of", "ticker", "signal", "pct_change", "confidence", "grade")


def _html_sql() -> str:
    cells = _cell_sql()
    return f"select as_of, ticker, '<tr><td>' || ticker || '</td><td>' || signal || '</td><td>' || pct_change || '</td><td>' || confidence || '</td><td>' || grade || '</td></tr>' as line from ({cells})"


@query(oracle.panel_sql(MANY, _html_sql()))
def html_report_rows(spark, sf_dir):
    """The rows of a report's HTML table, as ``write_html`` writes them."""
    shown = report.displayed(display.cells(records(spark, sf_dir)))
    columns = ["ticker", "signal", "pct_change", "confidence", "grade"]
    return exports.html_rows(shown.select(*columns, "as_of", F.col("ticker").alias("key")), keep={"as_of": "as_of", "key": "ticker"})


@query(f"""with {oracle.UNIVERSE} select base64(encode('ticker,seq' || chr(10) || string_agg(ticker || ',' || seq || chr(10), '' order by seq))) as csv_base64 from universe""")
def csv_base64(spark, sf_dir):
    return exports.csv_base64(all_tickers(spark, sf_dir).select("ticker", F.col("seq").alias("seq"), F.col("seq").alias("__pos")), "__pos")


@query(oracle.panel_sql(MANY, """select base64(encode('ticker,sector,signal,grade,details' || chr(10) || coalesce(string_agg(concat_ws(',', ticker, sector, signal, grade,
  '"' || replace(details, '"', '""') || '"') || chr(10), '' order by as_of, seq), ''))) as csv_base64 from results where side is not null"""))
def csv_base64_report(spark, sf_dir):
    """The actionable rows of a report as CSV, with the HTML of their details, as base64."""
    rows = records(spark, sf_dir).where(sig.is_actionable())
    return exports.csv_base64(rows.select("ticker", "sector", "signal", "grade", "details", F.struct("as_of", "seq").alias("__pos")), "__pos")


@query(f"""with {oracle.BARS}, lines as (select ticker, bar_date, ticker || ',' || bar_date || ',' || close || ',' || volume::bigint || chr(10) as line from bars),
whole as (select base64(encode('ticker,bar_date,close,volume' || chr(10) || string_agg(line, '' order by ticker, bar_date))) as b from lines)
select part, substr(b, part * {exports.PART // 3 * 4} + 1, {exports.PART // 3 * 4}) as csv_base64 from (select b, unnest(range(0, (length(b) + {exports.PART // 3 * 4 - 1}) // {exports.PART // 3 * 4})) as part from whole)""")
def csv_base64_of_bars(spark, sf_dir):
    """All closes as one CSV text, as base64 in parts."""
    bars = all_bars(spark, sf_dir)
    rows = bars.select("ticker", "bar_date", "close", F.col("volume").cast("long").alias("volume"), F.struct("ticker", "bar_date").alias("__pos"))
    return exports.csv_base64_parts(rows, "__pos")


@query(oracle.panel_sql(MANY, f"select {_ROW_SQL}, row_number() over (order by side is not null desc, case when side is not null then {_RANK_SQL} end desc nulls last, as_of, seq)::int as pos from results"))
def results_numbered(spark, sf_dir):
    """The results of all dates in one order."""
    rows = records(spark, sf_dir).withColumn("tie", F.struct("as_of", "seq"))
    return _row(report.positions(rows, "tie"), "pos")


@query(oracle.panel_sql((FLAGSHIP,), f"select {_ROW_SQL}, details from results"))
def full_analysis(spark, sf_dir):
    """Universe, bars, signals, scores, sectors and order, as of one date."""
    done = analysis.run(all_tickers(spark, sf_dir), bars_for(spark, sf_dir, FLAGSHIP), stored_sectors(spark, sf_dir), FLAGSHIP, keep=False)
    return _row(done.results, "details")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
