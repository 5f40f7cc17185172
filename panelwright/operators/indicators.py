"""The indicators of the model, layer by layer.

Every function adds columns to a panel of filled, cleaned rows. A layer's windows read columns of the
layers before; all windows share one partitioning and order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.arrays import before, deviation, last_centre, less, let, more, moving, total
from panelwright.functions.scalar import bounded, clip, floor_eps, or_else, true, zero_if_odd
from panelwright.functions.windows import Frame
from panelwright.params import ADAPTIVE, BAND, EPSILON, IMPACT_LAG, LOOKBACK_DAYS, MICRO, PIVOT, SMOOTH, SURGE
from panelwright.schema import FIELDS

FRAME = Frame()


def whole_windows(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    """Row numbers, the row before, and values over all rows of the filled columns themselves."""
    rows = rows.withColumns({"body": F.abs(F.col("close") - F.col("open")), "spread": (F.col("high") + F.col("low")) / 2 - F.col("open")})
    return rows.withColumns({"row": w.row, "prev_close": w.lag("close"), "v_all": w.mean("volume"), "v_sd_all": w.deviation("volume"), "c_sd_all": w.deviation("close")})


def volume_means(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    """The close to compare with, and the mean volume, of the rows before."""
    rows = rows.withColumns({"old_close": w.lag("close", IMPACT_LAG), "v_sma": w.sma("volume", ADAPTIVE)})
    return rows.withColumn("volume_mean", floor_eps(or_else(F.col("v_sma"), F.col("v_all"))))


def near_windows(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    """Deviations, the mean close and bodies of the rows before."""
    return rows.withColumns({
        "v_sd": w.stdev("volume", MICRO),
        "c_sma": w.sma("close", ADAPTIVE),
        "c_sd": w.stdev("close", ADAPTIVE),
        **{f"body_{k}": w.lag("body", k) for k in range(1, MICRO + 1)},
    })


def raw_windows(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    """Window values of the filled columns themselves."""
    return near_windows(volume_means(whole_windows(rows, w), w), w)


def body_conviction(rows: DataFrame) -> DataFrame:
    """Percentage of the up to nine bodies before that are smaller than the current one; signed by the bar's direction."""
    before = [F.col(f"body_{k}") for k in range(1, MICRO + 1)]
    less = sum((F.when(b < F.col("body"), 1).otherwise(0) for b in before[1:]), F.when(before[0] < F.col("body"), 1).otherwise(0))
    n = F.least(F.col("row"), F.lit(MICRO))
    rows = rows.withColumn("body_conviction", or_else(F.try_divide(less * 100.0, n.cast("double")), 0))
    up = F.col("close") > F.col("open")
    return rows.withColumn("direction_conviction", F.when(up, F.col("body_conviction")).otherwise(-F.col("body_conviction")))


def volume_surge(rows: DataFrame) -> DataFrame:
    sd = floor_eps(or_else(F.col("v_sd"), F.col("v_sd_all")))
    rows = rows.withColumn("volume_z", bounded(zero_if_odd(F.try_divide(F.col("volume") - F.col("volume_mean"), sd)), -5, 5))
    rows = rows.withColumn("vol_surge", bounded(F.col("volume_z") * 20 + 50, 0, 100))
    return rows.withColumn("volume_direction", F.when(F.col("close") > F.col("open"), F.col("vol_surge")).otherwise(-F.col("vol_surge")))


def speed(close: Column, before: Column) -> Column:
    return bounded(zero_if_odd(F.try_divide(close - before, clip(before, lo=EPSILON)) * 10000), -1000, 1000)


def velocity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("velocity", speed(F.col("close"), F.col("prev_close")))


def money_by_direction(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("money_flow", zero_if_odd((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")))
    up, down = true(F.col("close") > F.col("prev_close")), true(F.col("close") < F.col("prev_close"))
    return rows.withColumns({"up_flow": F.when(up, F.col("money_flow")).otherwise(0.0), "down_flow": F.when(down, F.col("money_flow")).otherwise(0.0)})


def relative_flows(rows: DataFrame) -> DataFrame:
    """Weighted spread and price impact."""
    return rows.withColumns({
        "spread_flow": F.try_divide(F.col("spread") * F.col("volume"), F.col("volume_mean")),
        "impact_flow": F.try_divide((F.col("close") - F.col("old_close")) * F.col("volume"), F.col("volume_mean")),
    })


def flows(rows: DataFrame) -> DataFrame:
    """What the second window layer averages: weighted spread, price impact, money flow by direction, velocity."""
    return velocity(relative_flows(money_by_direction(rows)))


def gains(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    return by_direction(rows.withColumn("velocity_diff", w.diff("velocity")))


def by_direction(rows: DataFrame) -> DataFrame:
    """Gain and loss of velocity."""
    return rows.withColumns({
        "gain": F.when(F.col("velocity_diff").isNotNull(), F.greatest("velocity_diff", F.lit(0.0))),
        "loss": F.when(F.col("velocity_diff").isNotNull(), F.greatest(-F.col("velocity_diff"), F.lit(0.0))),
    })


def liquidity(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    rows = rows.withColumns({"vwap_spread": or_else(w.sma("spread_flow", ADAPTIVE), 0), "price_impact": or_else(w.sma("impact_flow", ADAPTIVE), 0)})
    return rows.withColumn("liquidity", zero_if_odd(F.col("vwap_spread") - F.col("price_impact")))


def money_sums(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    return rows.withColumns({"positive_flow": or_else(w.sma("up_flow", MICRO), 0), "negative_flow": or_else(w.sma("down_flow", MICRO), 0)})


def volume_score(rows: DataFrame) -> DataFrame:
    """Accumulation and volume score."""
    balance = F.try_divide(F.col("positive_flow") - F.col("negative_flow"), F.col("positive_flow") + F.col("negative_flow") + EPSILON)
    rows = rows.withColumn("accumulation", bounded(zero_if_odd(balance), -1, 1))
    return rows.withColumn("volume_score", zero_if_odd(F.col("volume_direction") / 100 * 0.5 + F.col("accumulation") * 0.5))


def liquidity_and_flow(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    """Liquidity score, accumulation, volume score."""
    return volume_score(gains(money_sums(liquidity(rows, w), w), w))


def liquidity_windows(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    return rows.withColumns({"l_sma": w.sma("liquidity", ADAPTIVE), "l_sd": w.stdev("liquidity", ADAPTIVE)})


def strength(rows: DataFrame, w: Frame = FRAME, adjust: bool = True, span: int | None = LOOKBACK_DAYS + 1) -> DataFrame:
    """The RSI of velocity; ``span`` bounds a range's rows, None if nothing does."""
    return w.wilder_rsi(rows, "gain", "loss", "row", MICRO, adjust, span)


def normal_values(rows: DataFrame) -> DataFrame:
    sd = floor_eps(or_else(F.col("l_sd"), 1), zero_as=1.0)
    return rows.withColumns({
        "normalized_liq": bounded(zero_if_odd(F.try_divide(F.col("liquidity") - or_else(F.col("l_sma"), 0), sd)), -10, 10),
        "momentum_rsi": bounded(or_else(F.col("rsi"), 50), 0, 100),
    })


def normalised(rows: DataFrame, w: Frame = FRAME, adjust: bool = True, span: int | None = LOOKBACK_DAYS + 1) -> DataFrame:
    """Normalised liquidity and the RSI of velocity; ``span`` as in ``strength``."""
    return normal_values(strength(liquidity_windows(rows, w), w, adjust, span))


def bands(rows: DataFrame) -> DataFrame:
    middle, sd = or_else(F.col("c_sma"), F.col("close")), floor_eps(or_else(F.col("c_sd"), F.col("c_sd_all")))
    rows = rows.withColumns({"upper_band": middle + sd * BAND, "lower_band": middle - sd * BAND})
    return rows.withColumns({"overbought": true(F.col("close") > F.col("upper_band")), "oversold": true(F.col("close") < F.col("lower_band"))})


def oscillator(rows: DataFrame) -> DataFrame:
    raw = F.col("normalized_liq") * 0.30 + F.col("volume_score") * 0.25 + F.col("direction_conviction") / 100 * 0.25 + (F.col("momentum_rsi") - 50) / 50 * 0.20
    rows = rows.withColumn("raw_score", bounded(zero_if_odd(raw), -5, 5))
    return rows.withColumn("ilfo_value", bounded(zero_if_odd(F.col("raw_score") * 8), -10, 10))


def momentum(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    return rows.withColumn("osc_momentum", or_else(clip(w.diff("ilfo_value", 2), -15, 15), 0))


def pivots(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    """Pivots, which are extremes of the 21 rows around them."""
    rows = rows.withColumns({"low_around": w.centred(F.min, "low", PIVOT), "high_around": w.centred(F.max, "high", PIVOT)})
    return rows.withColumns({"pivot_low": true(F.col("low") == F.col("low_around")), "pivot_high": true(F.col("high") == F.col("high_around"))})


def momentum_and_pivots(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    """Oscillator momentum and signal line; pivots."""
    rows = momentum(rows, w).withColumn("signal_line", bounded(or_else(w.sma("ilfo_value", SMOOTH), 0), -10, 10))
    return pivots(rows, w)


def acceleration_and_last_pivots(rows: DataFrame, w: Frame = FRAME) -> DataFrame:
    """Acceleration, and price and oscillator at the last pivot so far (the row's own values before the first one)."""
    last = lambda flag, x: F.coalesce(w.carried(F.when(F.col(flag), F.col(x))), F.col(x))
    return rows.withColumns({
        "osc_accel": or_else(clip(w.diff("osc_momentum"), -15, 15), 0),
        "last_low": last("pivot_low", "low"),
        "last_low_osc": last("pivot_low", "ilfo_value"),
        "last_high": last("pivot_high", "high"),
        "last_high_osc": last("pivot_high", "ilfo_value"),
    })


def masks(rows: DataFrame) -> DataFrame:
    """Divergences and extremes."""
    busy, surge = F.col("volume") > F.col("volume_mean") * 0.8, F.col("vol_surge") > SURGE
    return rows.withColumns({
        "bull_div": true((F.col("low") < F.col("last_low") * 0.998) & (F.col("ilfo_value") > F.col("last_low_osc") * 1.05) & F.col("oversold") & busy),
        "bear_div": true((F.col("high") > F.col("last_high") * 1.002) & (F.col("ilfo_value") < F.col("last_high_osc") * 0.95) & F.col("overbought") & busy),
        "x_long": true(F.col("oversold") & (F.col("osc_momentum") > 0) & (F.col("osc_accel") > 0) & surge),
        "x_short": true(F.col("overbought") & (F.col("osc_momentum") < 0) & (F.col("osc_accel") < 0) & surge),
    })


def percent_change(rows: DataFrame) -> DataFrame:
    ok = F.col("prev_close") > 0
    return rows.withColumn("pct_change", F.when(ok, (F.try_divide("close", "prev_close") - 1) * 100))


#: The layers in order, each named after what it completes.
LAYERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "raw_windows": raw_windows,
    "body_conviction": body_conviction,
    "volume_surge": volume_surge,
    "bands": bands,
    "percent_change": percent_change,
    "flows": flows,
    "liquidity_and_flow": liquidity_and_flow,
    "normalised": normalised,
    "oscillator": oscillator,
    "momentum_and_pivots": momentum_and_pivots,
    "acceleration_and_last_pivots": acceleration_and_last_pivots,
    "masks": masks,
}


def computed(rows: DataFrame, through: str = "masks", span: int | None = LOOKBACK_DAYS + 1) -> DataFrame:
    """All layers up to and including ``through``; ``span`` as in ``normalised``."""
    for name, layer in LAYERS.items():
        rows = layer(rows, span=span) if layer is normalised else layer(rows)
        if name == through:
            return rows
    raise KeyError(through)


#: Rows at the end of a range whose oscillator the last row's acceleration depends on.
_ENDS = 4


def last_computed(rows: DataFrame, span: int | None = LOOKBACK_DAYS + 1, w: Frame = FRAME) -> DataFrame:
    """All layers, right for the last row of each range; few other rows are kept.

    A last row depends on the oscillator of the last rows and of the last pivots only, and those on at most twice
    21 rows before them besides the mean volumes. Whatever depends on a range's start (row numbers, means of all rows, the RSI),
    the pivots and the mean volumes, which are of filled columns, come first, in two layers of windows, as a layer costs a copy
    of each row; then each layer of averages drops the rows that no later one reads. Of guarded tickers only the last row is left.
    """
    rows = whole_windows(rows, w).withColumns({"__old": w.lag("close", 2), "__count": F.count(F.lit(1)).over(w.whole)})
    rows = volume_means(pivots(rows, w), w).withColumn("__end", F.col("__count") - 1)
    # the velocity before is that of the two closes before
    diff = F.when(F.col("row") > 0, speed(F.col("close"), F.col("prev_close")) - speed(F.col("prev_close"), F.col("__old")))
    rows = by_direction(rows.withColumn("velocity_diff", diff))
    rows = rows.withColumns({"__low": F.when(F.col("pivot_low"), F.col("row")), "__high": F.when(F.col("pivot_high"), F.col("row"))})
    rows = strength(rows, w, True, span).withColumns({c: F.max(c).over(w.whole) for c in ("__low", "__high")})

    def kept(rows: DataFrame, before: int) -> DataFrame:
        """The rows that are needed and so many before each."""
        row = F.col("row")
        wanted = row > F.col("__end") - _ENDS - before
        for at in ("__low", "__high"):
            wanted = wanted | true(row.between(F.col(at) - before, F.col(at)))
        return rows.where(F.when(F.col("status").isNull(), wanted).otherwise(row == F.col("__end")))

    n = ADAPTIVE - 1
    rows = liquidity(relative_flows(kept(rows, 2 * n)), w)
    rows = money_sums(near_windows(liquidity_windows(money_by_direction(kept(rows, n)), w), w), w)
    rows = kept(rows, 0)
    for layer in (body_conviction, volume_surge, volume_score, bands, percent_change, normal_values, oscillator, momentum, acceleration_and_last_pivots, masks):
        rows = layer(rows)
    return rows.drop("__old", "__count", "__end", "__low", "__high")


#: Rows before a row whose oscillator is wanted that it reads: those of three averages of averages.
_REACH = 3 * (ADAPTIVE - 1)


def last_of_ranges(ranges: DataFrame) -> DataFrame:
    """``last_computed`` of whole ranges as arrays (see ``align.ranged``); only the rows that it is left with become rows.

    ``bar_date`` is the range's last one; ``row`` orders the rows.
    """
    fine, n = F.col("status").isNull(), F.col("n")
    speeds = F.zip_with("close", before(F.col("close")), lambda x, b: F.when(x == b, 0.0).otherwise(speed(x, b)))
    rows = ranges.withColumns({
        "__low_at": last_centre(F.col("low"), PIVOT, less),
        "__high_at": last_centre(F.col("high"), PIVOT, more),
        "__diffs": let(speeds, lambda v: F.zip_with(v, before(v), lambda x, b: x - b)),
        "v_all": total(F.col("volume")) / n,
    })
    ends = F.array("__low_at", "__high_at", *[n - k for k in range(_ENDS, 0, -1)])
    rows = rows.withColumn("__rows", F.when(fine, F.array_sort(F.array_distinct(F.array_compact(ends)))).otherwise(F.array(n - 1)))
    rows = rows.withColumn("__from", F.greatest(F.array_min("__rows") - _REACH, F.lit(0)))
    kept = F.lit((MICRO - 1) / MICRO)
    # the decayed sums of gains and losses at each wanted row, from those at the one before
    run = lambda s, d, sign: F.aggregate(d, s, lambda y, x: F.when(x * sign > 0, y * kept + x * sign).otherwise(y * kept))
    state = lambda at, up, down, sums: F.struct(at.cast("int").alias("at"), up.alias("up"), down.alias("down"), sums.cast("array<struct<up:double,down:double>>").alias("sums"))

    def advanced(acc: Column, p: Column) -> Column:
        part = F.slice("__diffs", acc["at"] + 1, p + 1 - acc["at"])
        sums = let(part, lambda d: F.struct(run(acc["up"], d, 1.0).alias("up"), run(acc["down"], d, -1.0).alias("down")))
        return let(sums, lambda s: state(p + 1, s["up"], s["down"], F.concat(acc["sums"], F.array(s))))

    sums = F.aggregate("__rows", state(F.lit(0), F.lit(0.0), F.lit(0.0), F.array()), advanced, lambda acc: acc["sums"])
    rows = rows.withColumns({"__sums": F.when(fine, sums), **{f: F.slice(f, F.col("__from") + 1, n - F.col("__from")) for f in FIELDS}}).drop("__diffs")
    start = ADAPTIVE - 1
    size = F.size("volume")
    full = lambda x: F.slice(moving(x, ADAPTIVE), 1, size - start)
    # before the 21st row of a range the mean of all volumes; of a part the rows there aren't wanted
    means = F.transform(full(F.col("volume")), lambda s: floor_eps(s / ADAPTIVE))
    rows = rows.withColumn("__vm", F.concat(F.array_repeat(floor_eps(F.col("v_all")), start), means))
    spread = F.zip_with(F.zip_with("high", "low", lambda h, b: (h + b) / 2), "open", lambda m, o: m - o)
    old = F.concat(F.array_repeat(F.lit(None).cast("double"), IMPACT_LAG), F.slice("close", 1, size - IMPACT_LAG))
    change = F.zip_with("close", old, lambda c, o: c - o)
    weighted = lambda x: F.zip_with(F.zip_with(x, "volume", lambda y, v: y * v), "__vm", F.try_divide)
    mean = lambda x: or_else(x / ADAPTIVE, 0)
    liquid = F.zip_with(full(weighted(spread)), full(weighted(change)), lambda s, i: zero_if_odd(mean(s) - mean(i)))
    rows = rows.withColumn("__liquidity", F.concat(F.array_repeat(F.lit(0.0), start), liquid))
    at = lambda c, i: F.get(F.col(c), i)
    rows = rows.drop("n").withColumnsRenamed({f: f"__{f}" for f in FIELDS}).select("*", F.posexplode_outer("__rows").alias("__k", "row"))
    q, row = F.col("row") - F.col("__from"), F.col("row")
    value = lambda f, k=0: at(f"__{f}", q - k)
    last = lambda c, k: F.when(row >= k - 1, F.slice(c, F.greatest(q - (k - 2), F.lit(1)), k))
    money = lambda i: zero_if_odd((at("__high", i) + at("__low", i) + at("__close", i)) / 3 * at("__volume", i))
    rises = lambda i: at("__close", i) > at("__close", i - 1)
    falls = lambda i: at("__close", i) < at("__close", i - 1)
    flow = lambda moved: F.when(row >= MICRO - 1, F.aggregate(F.sequence(q - (MICRO - 1), q), F.lit(0.0), lambda s, i: s + F.when(moved(i), money(i)).otherwise(0.0)) / MICRO)
    none = F.lit(None).cast("double")
    sums = at("__sums", F.col("__k"))
    rows = rows.select(
        "as_of", "ticker", "bar_date", "status", "status_details", "row", "v_all", *[value(f).alias(f) for f in FIELDS],
        value("close", 1).alias("prev_close"),
        value("vm").alias("volume_mean"),
        value("liquidity").alias("liquidity"),
        *[F.abs(value("close", k) - value("open", k)).alias(f"body_{k}" if k else "body") for k in range(MICRO + 1)],
        deviation(last("__volume", MICRO), MICRO).alias("v_sd"),
        (total(last("__close", ADAPTIVE)) / ADAPTIVE).alias("c_sma"),
        deviation(last("__close", ADAPTIVE), ADAPTIVE).alias("c_sd"),
        # all wanted rows have enough rows before them
        none.alias("v_sd_all"), none.alias("c_sd_all"),
        (total(last("__liquidity", ADAPTIVE)) / ADAPTIVE).alias("l_sma"),
        deviation(last("__liquidity", ADAPTIVE), ADAPTIVE).alias("l_sd"),
        or_else(flow(rises), 0).alias("positive_flow"),
        or_else(flow(falls), 0).alias("negative_flow"),
        F.when(row >= MICRO, F.try_divide(sums["up"] * 100.0, sums["up"] + sums["down"])).alias("rsi"),
        true(row == F.col("__low_at")).alias("pivot_low"),
        true(row == F.col("__high_at")).alias("pivot_high"),
    )
    for layer in (body_conviction, volume_surge, volume_score, bands, percent_change, normal_values, oscillator):
        rows = layer(rows)
    w = Frame(order="row")
    return masks(acceleration_and_last_pivots(momentum(rows, w), w))
