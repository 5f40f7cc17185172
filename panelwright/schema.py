"""Fixed schemas of the tables that the operators exchange."""

from __future__ import annotations

BARS = "ticker string, bar_date date, open double, high double, low double, close double, volume double"
UNIVERSE = "seq long, ticker string"
SECTORS = "ticker string, sector string"
PARAMS = "side string, param string, ord int, lo double, hi double, weight double, importance string, median double, fail_mean double, spread double"

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume")
#: Values that a signal record carries and the score reads, in this order.
CRITERIA = ("ilfo_value", "vol_surge", "momentum_rsi", "osc_momentum", "osc_accel", "volume_score", "normalized_liq")
#: A signal record: one row per ticker and as-of date.
SIGNALS = ("ticker", "signal", "details", "pct_change", "confidence_score", "confidence_grade", "confidence_class", *CRITERIA)
#: A result row: the record under its display names, with its sector.
RESULTS = ("ticker", "signal", "pct_change", "confidence", "grade", "details", *CRITERIA, "confidence_class")
