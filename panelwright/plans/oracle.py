"""The same plans as DuckDB SQL, for checking results on another engine."""

from __future__ import annotations

import re

CRITERIA = ("ilfo_value", "vol_surge", "momentum_rsi", "osc_momentum", "osc_accel", "volume_score", "normalized_liq")
LONG_SIGNALS, SHORT_SIGNALS = ("Extreme Long", "Long", "Divergence Long"), ("Extreme Short", "Short", "Divergence Short")
BUCKETS = (*LONG_SIGNALS, *SHORT_SIGNALS, "Neutral", "Error")
# Fixed values, written out a second time so that a wrong constant of the library shows:
# side, param, ord, lo, hi, weight, importance, median, fail mean.
TABLE = (
    ("Long", "ilfo_value", 0, 0.362, 2.521, 0.13, "critical", 2.399, 2.315),
    ("Long", "normalized_liq", 1, 1.158, 2.010, 0.12, "low", 1.999, 1.798),
    ("Long", "vol_surge", 2, 60.354, 72.076, 0.13, "high", 71.887, 74.562),
    ("Long", "momentum_rsi", 3, 41.230, 45.518, 0.13, "high", 45.282, 45.023),
    ("Long", "osc_momentum", 4, 1.973, 4.491, 0.13, "medium", 1.983, 2.384),
    ("Long", "osc_accel", 5, -0.438, 1.962, 0.12, "medium", 1.858, 1.856),
    ("Long", "volume_score", 6, -0.551, -0.318, 0.12, "low", -0.541, -0.455),
    ("Long", "confidence_score", 7, 7.148, 57.958, 0.0, "low", 0.0, 4.231),
    ("Long", "body_conviction", 8, 88.889, 100.0, 0.12, "low", 72.222, 62.5),
    ("Short", "ilfo_value", 0, -2.600, -0.590, 0.13, "critical", -2.532, -2.415),
    ("Short", "normalized_liq", 1, -1.359, 2.527, 0.12, "low", -2.024, -1.865),
    ("Short", "vol_surge", 2, 60.449, 72.079, 0.12, "high", 72.262, 73.775),
    ("Short", "momentum_rsi", 3, 53.625, 57.618, 0.12, "high", 53.762, 54.208),
    ("Short", "osc_momentum", 4, -1.931, -0.160, 0.13, "medium", -1.788, -2.122),
    ("Short", "osc_accel", 5, -4.572, -1.777, 0.12, "medium", -1.809, -1.654),
    ("Short", "volume_score", 6, 0.737, 1.000, 0.13, "low", 0.635, 0.507),
    ("Short", "confidence_score", 7, 8.149, 45.797, 0.0, "low", 0.558, 4.855),
    ("Short", "body_conviction", 8, 66.667, 88.889, 0.13, "low", 66.667, 60.488),
)
_SPREAD = "(case when abs({0} - {1}) >= 1e-6 then abs({0} - {1}) when 0.1 * abs({0}) >= 1e-6 then 0.1 * abs({0}) else 0.1 end)"
PARAMS = "params as (select *, " + _SPREAD.format("median", "fail_mean") + " as spread from (values " + ", ".join(str(r) for r in TABLE) + ") t(side, param, ord, lo, hi, weight, importance, median, fail_mean))"
INDICES = """(values ('NIFTY 50', 'ind_nifty50list.csv'), ('NIFTY NEXT 50', 'ind_niftynext50list.csv'), ('NIFTY 100', 'ind_nifty100list.csv'),
  ('NIFTY 200', 'ind_nifty200list.csv'), ('NIFTY 500', 'ind_nifty500list.csv'), ('NIFTY MIDCAP 50', 'ind_niftymidcap50list.csv'),
  ('NIFTY MIDCAP 100', 'ind_niftymidcap100list.csv'), ('NIFTY SMLCAP 100', 'ind_niftysmallcap100list.csv'), ('NIFTY BANK', 'ind_niftybanklist.csv'),
  ('NIFTY AUTO', 'ind_niftyautolist.csv'), ('NIFTY FIN SERVICE', 'ind_niftyfinancelist.csv'), ('NIFTY FMCG', 'ind_niftyfmcglist.csv'),
  ('NIFTY IT', 'ind_niftyitlist.csv'), ('NIFTY MEDIA', 'ind_niftymedialist.csv'), ('NIFTY METAL', 'ind_niftymetallist.csv'),
  ('NIFTY PHARMA', 'ind_niftypharmalist.csv')) t(index_name, path)"""
INDEX_NAMES = str(re.findall(r"\('([^']+)', 'ind", INDICES))
# The cells' classes.
SIGNAL_CLASS = """case signal when 'Extreme Long' then 'signal-extreme-long' when 'Long' then 'signal-long' when 'Divergence Long' then 'signal-div-long'
  when 'Extreme Short' then 'signal-extreme-short' when 'Short' then 'signal-short' when 'Divergence Short' then 'signal-div-short'
  when 'Neutral' then 'signal-neutral' else 'signal-error' end"""

_ROUND = "floor(({0}) * 10000.0 + 0.500001) / 10000.0"
_FIELDS = ("open", "high", "low", "close", "volume")


def r4(x: str, alias: str | None = None) -> str:
    return f"{_ROUND.format(x)} as {alias or x}"


def printed(x: str, decimals: int) -> str:
    """Text with a number of decimals, rounded half away from zero; rounding errors at ties and at 0 don't show."""
    ten = 10.0**decimals
    return f"printf('%.{decimals}f', case when abs({x}) < 1e-9 then 0.0 else sign({x}) * floor(abs({x}) * {ten} + 0.500001) / {ten} end)"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(case when ({x}) is not null then greatest({lo}, least({hi}, {x})) end)"


def z(x: str) -> str:
    return f"(case when ({x}) is null or isnan({x}) or isinf({x}) then 0.0 else ({x}) end)"


def sma(x: str, n: int, f: str = "avg") -> str:
    return f"(case when count({x}) over w{n} = {n} then {f}({x}) over w{n} end)"


def sd(x: str, n: int) -> str:
    return sma(x, n, "stddev_samp")


_BY = "partition by as_of, ticker order by bar_date"
WINDOWS = f"""window w as ({_BY}), so_far as ({_BY} rows between unbounded preceding and current row),
  whole as (partition by as_of, ticker), from_here as ({_BY} rows between current row and unbounded following),
  w5 as ({_BY} rows between 4 preceding and current row), w9 as ({_BY} rows between 8 preceding and current row),
  w21 as ({_BY} rows between 20 preceding and current row), centre as ({_BY} rows between 10 preceding and 10 following)"""

BARS = """walk as (
  select l_suppkey, l_shipdate::date as bar_date, l_quantity, l_quantity - 25.5 as step, row_number() over o as seq,
    sum(l_quantity - 25.5) over (o rows between unbounded preceding and current row) as walk
  from lineitem window o as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
trades as (select *, exp(0.001 * walk) * 100.0 as price, exp(0.001 * walk) * 100.0 * exp(-0.001 * step) as pre from walk),
daily as (
  select l_suppkey, bar_date, round(arg_min(pre, seq), 6) as open, round(max(greatest(price, pre)), 6) as high,
    round(min(least(price, pre)), 6) as low, round(arg_max(price, seq), 6) as close, sum(l_quantity) as volume
  from trades group by l_suppkey, bar_date),
bars as (select s_name || '.NS' as ticker, bar_date, open, high, low, close, volume from daily join supplier on s_suppkey = l_suppkey)"""

#: Bars of some tickers made odd: no volume, a close of zero, few rows, volumes of zero and less, no close.
ODD_BARS = BARS.replace("\nbars as (", "\nbars0 as (") + """,
numbered as (select *, substring(ticker, 10, 9)::int % 6 as kind from bars0),
bars as (
  select ticker, bar_date, open, high, low,
    case when kind = 2 and day(bar_date) = 15 then 0.0 when kind = 5 then null else close end as close,
    case when kind = 1 then null when kind = 4 then (day(bar_date) % 3 - 1)::double else volume end as volume
  from numbered where kind <> 3 or bar_date > date '2001-05-31')"""

#: Bars adjusted for splits and dividends made from the largest trades; factors are multiplied from the last action on, as equal
#: sets of actions have to give equal factors to the last bit.
ADJUSTED_BARS = BARS.replace("\nbars as (", "\nbars0 as (") + """,
actions as (
  select s_name || '.NS' as ticker, l_shipdate::date as bar_date, case when l_quantity = 50 and l_discount >= 0.08 then 1.0 + l_linenumber / 4 end as ratio,
    case when not (l_quantity = 50 and l_discount >= 0.08) then l_tax * 20 end as dividend
  from lineitem join supplier on s_suppkey = l_suppkey where l_quantity >= 49),
strictly as (
  select a.ticker, a.bar_date, coalesce(case when ratio > 0 then ratio end, 1.0) as shares,
    coalesce(case when dividend > 0 and dividend < b.close then 1 - dividend / b.close end, 1.0) as cash
  from actions a asof left join (select ticker, bar_date, close from bars0 where close is not null) b on a.ticker = b.ticker and a.bar_date > b.bar_date),
factors as (
  select b.ticker, b.bar_date, coalesce(product(s.cash order by s.bar_date desc, s.shares, s.cash), 1.0) as cash, coalesce(product(s.shares order by s.bar_date desc, s.shares, s.cash), 1.0) as shares
  from bars0 b left join strictly s on s.ticker = b.ticker and s.bar_date > b.bar_date group by b.ticker, b.bar_date),
bars as (
  select ticker, bar_date, open * (cash / shares) as open, high * (cash / shares) as high, low * (cash / shares) as low, close * (cash / shares) as close, volume * shares as volume
  from bars0 join factors using (ticker, bar_date))"""

#: Bars of some tickers without those that have no readable date; ``faults`` has what is wrong with tickers.
FAULTY_BARS = BARS.replace("\nbars as (", "\nbars0 as (") + """,
numbered as (select *, substring(ticker, 10, 9)::int % 7 as kind from bars0),
bars as (select ticker, bar_date, open, high, low, close, case when kind = 2 and day(bar_date) = 15 then null else volume end as volume from numbered where not (kind = 3 and day(bar_date) = 20))"""
FAULTS = """faults as (
  select as_of, ticker, case kind when 1 then 'repeated bar: ' || min(bar_date) when 2 then 'volume is not a number: n/a' else 'bar_date is not a date: ' || min(bar_date) || '?' end as text
  from numbered join days on kind = 3 and day(bar_date) = 20 or bar_date between as_of - 250 and as_of and (kind = 1 and day(bar_date) = 10 or kind = 2 and day(bar_date) = 15) group by as_of, ticker, kind)"""

UNIVERSE = "universe as (select row_number() over (order by s_suppkey) - 1 as seq, s_name || '.NS' as ticker from supplier where trim(s_name) <> '')"
SECTORS = "sectors as (select s_name || '.NS' as ticker, n_name as sector from supplier join nation on n_nationkey = s_nationkey where s_nationkey % 5 <> 0)"


def aligned(as_ofs: tuple[str, ...], align: str = "union") -> str:
    days = ", ".join(f"(date '{d}')" for d in as_ofs)
    grid = "live join calendar using (as_of)" if align == "union" else "(select as_of, ticker, bar_date from ranged) join live using (as_of, ticker)"
    return f"""days(as_of) as (values {days}),
ranged as (select as_of, b.* from bars b join days on bar_date between as_of - 250 and as_of),
live as (select as_of, ticker from ranged group by all having count(close) > 0),
calendar as (select distinct as_of, bar_date from ranged),
aligned as (select as_of, ticker, bar_date, open, high, low, close, volume from {grid} left join ranged using (as_of, ticker, bar_date))"""


def filled() -> str:
    cols = ", ".join(f"coalesce(last_value({c} ignore nulls) over so_far, first_value({c} ignore nulls) over from_here) as {c}" for c in _FIELDS)
    return f"""filled as (select as_of, ticker, bar_date, {cols} from aligned {WINDOWS}),
counted as (select *, count(*) over whole as n, count(volume) over whole as nv, bool_or(close <= 0) over whole as bad from filled {WINDOWS}),
guarded as (select as_of, ticker, bar_date, open, high, low, close, greatest(coalesce(volume, 0), 1) as volume,
  case when n < 42 or nv = 0 then 'Insufficient Data' when bad then 'Invalid Data' end as status,
  case when n < 42 then 'N/A' when nv = 0 then 'Missing main series' when bad then 'Non-positive prices detected' end as status_details
  from counted)"""


def layers() -> str:
    """CTEs of all indicators; the last one is ``masks``."""
    less = " + ".join(f"(case when body_{k} < body then 1 else 0 end)" for k in range(1, 10))
    lags = ", ".join(f"lag(body, {k}) over w as body_{k}" for k in range(1, 10))
    eps = 1e-10
    return f"""
a0 as (select *, abs(close - open) as body, (high + low) / 2 - open as spread from guarded),
a1 as (select *, row_number() over w - 1 as row, lag(close) over w as prev_close, lag(close, 5) over w as old_close,
  greatest(coalesce({sma('volume', 21)}, avg(volume) over whole), {eps}) as volume_mean,
  {sd('volume', 9)} as v_sd, stddev_samp(volume) over whole as v_sd_all, {sma('close', 21)} as c_sma, {sd('close', 21)} as c_sd,
  stddev_samp(close) over whole as c_sd_all, {lags} from a0 {WINDOWS}),
a2 as (select *, case when row = 0 then 0.0 else ({less}) * 100.0 / least(row, 9) end as body_conviction,
  greatest(coalesce(nullif(coalesce(v_sd, v_sd_all), 0), {eps}), {eps}) as v_div,
  greatest(coalesce(nullif(coalesce(c_sd, c_sd_all), 0), {eps}), {eps}) as c_div, coalesce(c_sma, close) as middle from a1),
a3 as (select *, case when close > open then body_conviction else -body_conviction end as direction_conviction,
  {clip(z('(volume - volume_mean) / v_div'), -5.0, 5.0)} as volume_z,
  middle + c_div * 2.0 as upper_band, middle - c_div * 2.0 as lower_band,
  case when prev_close > 0 then (close / prev_close - 1) * 100 end as pct_change,
  (high + low + close) / 3 * volume as money_flow from a2),
a4 as (select *, {clip('volume_z * 20 + 50', 0.0, 100.0)} as vol_surge,
  coalesce(close > upper_band, false) as overbought, coalesce(close < lower_band, false) as oversold,
  spread * volume / volume_mean as spread_flow, (close - old_close) * volume / volume_mean as impact_flow,
  case when close > prev_close then money_flow else 0.0 end as up_flow, case when close < prev_close then money_flow else 0.0 end as down_flow,
  {clip(z(f'(close - prev_close) / greatest(prev_close, {eps}) * 10000'), -1000.0, 1000.0)} as velocity from a3),
a5 as (select *, case when close > open then vol_surge else -vol_surge end as volume_direction,
  coalesce({sma('spread_flow', 21)}, 0) as vwap_spread, coalesce({sma('impact_flow', 21)}, 0) as price_impact,
  coalesce({sma('up_flow', 9)}, 0) as positive_flow, coalesce({sma('down_flow', 9)}, 0) as negative_flow,
  velocity - lag(velocity) over w as velocity_diff from a4 {WINDOWS}),
a6 as (select *, vwap_spread - price_impact as liquidity,
  {clip(z(f'(positive_flow - negative_flow) / (positive_flow + negative_flow + {eps})'), -1.0, 1.0)} as accumulation,
  case when velocity_diff is not null then greatest(velocity_diff, 0) end as gain,
  case when velocity_diff is not null then greatest(-velocity_diff, 0) end as loss from a5),
a7 as (select *, volume_direction / 100 * 0.5 + accumulation * 0.5 as volume_score,
  coalesce({sma('liquidity', 21)}, 0) as l_mean, greatest(coalesce(nullif({sd('liquidity', 21)}, 0), 1), {eps}) as l_div,
  sum(gain * pow(9 / 8.0, row)) over so_far as gains, sum(loss * pow(9 / 8.0, row)) over so_far as losses, count(gain) over so_far as steps from a6 {WINDOWS}),
a8 as (select *, {clip(z('(liquidity - l_mean) / l_div'), -10.0, 10.0)} as normalized_liq,
  coalesce(case when steps >= 9 and gains + losses > 0 then gains * 100.0 / (gains + losses) end, 50) as momentum_rsi from a7),
a9 as (select *, {clip('normalized_liq * 0.30 + volume_score * 0.25 + direction_conviction / 100 * 0.25 + (momentum_rsi - 50) / 50 * 0.20', -5.0, 5.0)} as raw_score from a8),
b0 as (select *, {clip('raw_score * 8', -10.0, 10.0)} as ilfo_value from a9),
b1 as (select *, coalesce({clip('ilfo_value - lag(ilfo_value, 2) over w', -15.0, 15.0)}, 0) as osc_momentum,
  {clip(f'coalesce({sma("ilfo_value", 5)}, 0)', -10.0, 10.0)} as signal_line,
  case when count(*) over centre = 21 then min(low) over centre end as low_around,
  case when count(*) over centre = 21 then max(high) over centre end as high_around from b0 {WINDOWS}),
b2 as (select *, coalesce(low = low_around, false) as pivot_low, coalesce(high = high_around, false) as pivot_high from b1),
b3 as (select *, coalesce({clip('osc_momentum - lag(osc_momentum) over w', -15.0, 15.0)}, 0) as osc_accel,
  coalesce(last_value(case when pivot_low then low end ignore nulls) over so_far, low) as last_low,
  coalesce(last_value(case when pivot_low then ilfo_value end ignore nulls) over so_far, ilfo_value) as last_low_osc,
  coalesce(last_value(case when pivot_high then high end ignore nulls) over so_far, high) as last_high,
  coalesce(last_value(case when pivot_high then ilfo_value end ignore nulls) over so_far, ilfo_value) as last_high_osc from b2 {WINDOWS}),
masks as (select *,
  coalesce(low < last_low * 0.998 and ilfo_value > last_low_osc * 1.05 and oversold and volume > volume_mean * 0.8, false) as bull_div,
  coalesce(high > last_high * 1.002 and ilfo_value < last_high_osc * 0.95 and overbought and volume > volume_mean * 0.8, false) as bear_div,
  oversold and osc_momentum > 0 and osc_accel > 0 and vol_surge > 60.0 as x_long,
  overbought and osc_momentum < 0 and osc_accel < 0 and vol_surge > 60.0 as x_short from b3)"""


def _score(side: str) -> str:
    rows = [r for r in TABLE if r[0] == side and r[1] in CRITERIA]
    near = {r[1]: f"greatest(0, 1 - abs({r[1]} - {r[7]!r}) / {_SPREAD.format(repr(r[7]), repr(r[8]))})" for r in rows}
    points = " + ".join(f"{near[r[1]]} * {r[5]!r} * 100" for r in rows)
    hits = lambda kind: " + ".join(f"(case when {near[r[1]]} > 0.5 then 1 else 0 end)" for r in rows if r[6] == kind)
    most = " + ".join(f"{r[5]!r} * 100" for r in TABLE if r[0] == side)
    bonus = f"(case when {hits('critical')} >= 2 then 5.0 when {hits('critical')} >= 1 and {hits('high')} >= 2 then 3.0 else 0.0 end)"
    return f"(least({points} + {bonus}, 100.0) / ({most}) * 100)"


_GRADE = "case when confidence_score >= 90 then 'A+' when confidence_score >= 80 then 'A' when confidence_score >= 70 then 'B+' when confidence_score >= 60 then 'B' when confidence_score >= 50 then 'C+' when confidence_score >= 40 then 'C' else 'D' end"
_CLASS = "case when confidence_score >= 90 then 'exceptional' when confidence_score >= 80 then 'excellent' when confidence_score >= 70 then 'good' when confidence_score >= 60 then 'acceptable' when confidence_score >= 50 then 'marginal' when confidence_score >= 40 then 'weak' else 'poor' end"


def _details() -> str:
    ranges = {(r[0], r[1]): r[3:5] for r in TABLE}

    def cell(label: str, p: str, d: int) -> str:
        inside = lambda side: f"{p} between {ranges[side, p][0]!r} and {ranges[side, p][1]!r}"
        css = f"case when contains(signal, 'Long') and {inside('Long')} then 'pct-positive' when not contains(signal, 'Long') and contains(signal, 'Short') and {inside('Short')} then 'pct-negative' else 'signal-neutral' end"
        return f"'{label}: <span class=\"' || ({css}) || '\">' || {printed(p, d)} || '</span>'"

    c = [cell("ILFO", "ilfo_value", 2), cell("NL", "normalized_liq", 2), cell("VolSurge", "vol_surge", 1), cell("MomRSI", "momentum_rsi", 2), cell("OscMom", "osc_momentum", 2), cell("OscAcc", "osc_accel", 2), cell("VolScore", "volume_score", 2)]
    return " || ' | ' || ".join(c[:4]) + " || '<br>' || " + " || ' | ' || ".join(c[4:])


def signals() -> str:
    """CTEs from masks to scored records, ``scored``."""
    crit = ", ".join(f"case when status is null then {c} end as {c}" for c in CRITERIA)
    return f"""
lasts as (select * from masks qualify row_number() over (partition by as_of, ticker order by bar_date desc) = 1),
classified as (select as_of, ticker, bar_date, status_details, coalesce(status, case when x_long and bull_div then 'Extreme Long' when x_short and bear_div then 'Extreme Short'
  when x_long then 'Long' when bull_div then 'Divergence Long' when x_short then 'Short' when bear_div then 'Divergence Short' else 'Neutral' end) as signal,
  case when status is null then pct_change end as pct_change, {crit} from lasts),
sided as (select *, case when contains(signal, 'Long') then 'Long' when contains(signal, 'Short') then 'Short' end as side,
  coalesce(status_details, {_details()}) as details from classified),
pointed as (select *, case side when 'Long' then {_score('Long')} when 'Short' then {_score('Short')} else 0.0 end as confidence_score from sided),
scored as (select *, case when contains(signal, 'Data') or contains(signal, 'Error') then 'D' when side is null then 'N/A' else {_GRADE} end as confidence_grade,
  case when contains(signal, 'Data') or contains(signal, 'Error') then 'poor' when side is null then 'neutral' else {_CLASS} end as confidence_class from pointed),
results as (select as_of, seq, ticker, coalesce(sector, 'Other') as sector, signal, side, pct_change, confidence_score as confidence, confidence_grade as grade, confidence_class, details,
  case when contains(signal, 'Data') or contains(signal, 'Error') then 'Error' else signal end as bucket, {', '.join(CRITERIA)}
  from scored join universe using (ticker) left join sectors using (ticker))"""


def panel_sql(as_ofs: tuple[str, ...], select: str, align: str = "union", through: str = "signals") -> str:
    """A query over the CTEs up to ``through``: bars, aligned, guarded, masks or signals."""
    steps = {"bars": "", "aligned": "", "guarded": "", "masks": "", "signals": ""}
    steps["bars"] = BARS
    steps["aligned"] = aligned(as_ofs, align)
    steps["guarded"] = filled()
    steps["masks"] = layers().strip()
    steps["signals"] = f"{UNIVERSE},\n{SECTORS},\n{signals().strip()}"
    names = list(steps)
    chosen = [steps[n] for n in names[: names.index(through) + 1]]
    return "with " + ",\n".join(chosen) + "\n" + select
