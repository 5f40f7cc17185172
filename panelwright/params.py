"""Constants of the model and its parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.schema import PARAMS

ADAPTIVE, MICRO, SMOOTH = 21, 9, 5
MIN_ROWS = 2 * ADAPTIVE
IMPACT_LAG = 5
BAND = 2.0
PIVOT = 10
SURGE = 60.0
EPSILON = 1e-10
LOOKBACK_DAYS = 250

# The model's ranges, weights, importance and anchors.
# param: (importance, Long (lo, hi, weight, median, fail mean), Short (the same))
_TABLE = {
    "ilfo_value": ("critical", (0.362, 2.521, 0.13, 2.399, 2.315), (-2.600, -0.590, 0.13, -2.532, -2.415)),
    "normalized_liq": ("low", (1.158, 2.010, 0.12, 1.999, 1.798), (-1.359, 2.527, 0.12, -2.024, -1.865)),
    "vol_surge": ("high", (60.354, 72.076, 0.13, 71.887, 74.562), (60.449, 72.079, 0.12, 72.262, 73.775)),
    "momentum_rsi": ("high", (41.230, 45.518, 0.13, 45.282, 45.023), (53.625, 57.618, 0.12, 53.762, 54.208)),
    "osc_momentum": ("medium", (1.973, 4.491, 0.13, 1.983, 2.384), (-1.931, -0.160, 0.13, -1.788, -2.122)),
    "osc_accel": ("medium", (-0.438, 1.962, 0.12, 1.858, 1.856), (-4.572, -1.777, 0.12, -1.809, -1.654)),
    "volume_score": ("low", (-0.551, -0.318, 0.12, -0.541, -0.455), (0.737, 1.000, 0.13, 0.635, 0.507)),
    "confidence_score": ("low", (7.148, 57.958, 0.0, 0.0, 4.231), (8.149, 45.797, 0.0, 0.558, 4.855)),
    "body_conviction": ("low", (88.889, 100.0, 0.12, 72.222, 62.5), (66.667, 88.889, 0.13, 66.667, 60.488)),
}
SIDES = ("Long", "Short")
GRADES = ((90, "A+", "exceptional"), (80, "A", "excellent"), (70, "B+", "good"), (60, "B", "acceptable"), (50, "C+", "marginal"), (40, "C", "weak"))
LOWEST_GRADE = ("D", "poor")
LONG_SIGNALS = ("Extreme Long", "Long", "Divergence Long")
SHORT_SIGNALS = ("Extreme Short", "Short", "Divergence Short")
BUCKETS = (*LONG_SIGNALS, *SHORT_SIGNALS, "Neutral", "Error")
OTHER_SECTOR = "Other"


def spread(median: float, fail_mean: float) -> float:
    """Distance of the anchors; a tenth of the median, or 0.1, where they coincide."""
    d = abs(median - fail_mean)
    if d < 1e-6:
        d = 0.1 * abs(median)
    return d if d >= 1e-6 else 0.1


def rows() -> list[tuple]:
    """(side, param, ord, lo, hi, weight, importance, median, fail_mean, spread) of every side and parameter."""
    return [(side, p, i, *v[1 + k][:3], v[0], *v[1 + k][3:], spread(*v[1 + k][3:])) for k, side in enumerate(SIDES) for i, (p, v) in enumerate(_TABLE.items())]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), PARAMS)
