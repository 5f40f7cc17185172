"""Display cells. Decimals are rounded half away from zero (see ``scalar.printed``), so texts may differ in the last digit from other printers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright import params
from panelwright.functions.scalar import printed

# The marks-up classes of the signals.
_SIGNAL_CLASS = {
    "Extreme Long": "signal-extreme-long",
    "Long": "signal-long",
    "Divergence Long": "signal-div-long",
    "Extreme Short": "signal-extreme-short",
    "Short": "signal-short",
    "Divergence Short": "signal-div-short",
}
#: Label, parameter and decimals of the details, in order; the line breaks after the fourth.
_DETAILS = (
    ("ILFO", "ilfo_value", 2),
    ("NL", "normalized_liq", 2),
    ("VolSurge", "vol_surge", 1),
    ("MomRSI", "momentum_rsi", 2),
    ("OscMom", "osc_momentum", 2),
    ("OscAcc", "osc_accel", 2),
    ("VolScore", "volume_score", 2),
)


def span(css, text: Column) -> Column:
    return F.concat(F.lit('<span class="'), css if isinstance(css, Column) else F.lit(css), F.lit('">'), text, F.lit("</span>"))


def detail_class(param: str, signal: str = "signal") -> Column:
    """Highlighted if the value is in its side's closed range."""
    ranges = {r[0]: r for r in params.rows() if r[1] == param}
    inside = lambda side: F.col(param).between(*ranges[side][3:5])
    s = F.col(signal)
    return (
        F.when(s.contains("Long"), F.when(inside("Long"), "pct-positive").otherwise("signal-neutral"))
        .when(s.contains("Short"), F.when(inside("Short"), "pct-negative").otherwise("signal-neutral"))
        .otherwise("signal-neutral")
    )


def details(signal: str = "signal") -> Column:
    cell = lambda label, p, d: F.concat(F.lit(f"{label}: "), span(detail_class(p, signal), printed(F.col(p), d)))
    cells = [cell(*x) for x in _DETAILS]
    return F.concat(F.concat_ws(" | ", *cells[:4]), F.lit("<br>"), F.concat_ws(" | ", *cells[4:]))


def with_details(signals: DataFrame) -> DataFrame:
    """Guarded tickers keep their guard's text."""
    return signals.withColumn("details", F.coalesce("status_details", details()))


def signal_cell(signal: Column) -> Column:
    css = None
    for name, c in _SIGNAL_CLASS.items():
        css = F.when(signal == name, c) if css is None else css.when(signal == name, c)
    css = css.when(signal.rlike("Error|Data"), "signal-error").otherwise("signal-neutral")
    return F.when(signal.isNull(), span("signal-neutral", F.lit("N/A"))).otherwise(span(css, signal))


def pct_cell(x: Column) -> Column:
    return (
        F.when(x.isNull(), span("pct-neutral", F.lit("N/A")))
        .when(x > 0, span("pct-positive", F.format_string("+%.2f%%", x)))
        .when(x < 0, span("pct-negative", F.format_string("%.2f%%", x)))
        .otherwise(span("pct-neutral", F.format_string("%.2f%%", x)))
    )


def confidence_cell(x: Column) -> Column:
    css = F.when(x >= 80, "confidence-high").when(x >= 60, "confidence-medium").otherwise("confidence-low")
    return F.when(x.isNull() | (x == 0), span("pct-neutral", F.lit("N/A"))).otherwise(span(css, F.format_string("%.1f%%", x)))


def grade_cell(g: Column) -> Column:
    css = F.concat(F.lit("grade-"), F.lower(F.replace(g, F.lit("+"), F.lit("-plus"))))
    return F.when(g.isNull() | (g == "N/A"), span("signal-neutral", F.lit("N/A"))).otherwise(span(css, g))


def cells(results: DataFrame) -> DataFrame:
    """Results with signal, percent change, confidence and grade as cells; an empty table passes."""
    return results.withColumns({
        "signal": signal_cell(F.col("signal")),
        "pct_change": pct_cell(F.col("pct_change")),
        "confidence": confidence_cell(F.col("confidence")),
        "grade": grade_cell(F.col("grade")),
    })
