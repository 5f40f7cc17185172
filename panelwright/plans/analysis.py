"""The whole analysis as one lazy plan: bars to signals, scores, sectors and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelwright.functions.windows import Frame
from panelwright.logs import logger, progress
from panelwright.operators import align, display, indicators, report, scoring
from panelwright.operators import signals as sig
from panelwright.params import LOOKBACK_DAYS
from panelwright.sources import sectors as sector_sources
from panelwright.sources import store
from panelwright.sources.actions import adjusted

#: A model: aligned panel rows in, classified last rows out.
Model = Callable[[DataFrame], DataFrame]


def panel(bars: DataFrame, as_ofs, align_on: str = "union", lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Filled, cleaned, guarded rows of each as-of range."""
    return align.filled_and_guarded(align.aligned(bars, as_ofs, align_on, lookback))


def flow_model(rows: DataFrame, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """The liquidity-flow oscillator model, for ranges of any number of days."""
    return sig.classified(sig.last_rows(indicators.last_computed(rows, lookback + 1)))


def flow_signals(bars: DataFrame, as_ofs, align_on: str = "union", lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """``flow_model`` of the panel, made of whole ranges as arrays: only the rows that a last row depends on become rows."""
    rows = indicators.last_of_ranges(align.ranged(bars, as_ofs, align_on, lookback))
    return sig.classified(sig.last_rows(rows, Frame(order="row")))


def signals(bars: DataFrame, as_ofs, align_on: str = "union", model: Model | None = None, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """A scored record per ticker and as-of date; the flow model unless another is given.

    Several as-of dates are exact by construction: arrays and windows are of one (as_of, ticker), so nothing
    of a date's range looks past it.
    """
    last = model(panel(bars, as_ofs, align_on, lookback)) if model else flow_signals(bars, as_ofs, align_on, lookback)
    return display.with_details(scoring.scored(last))


@dataclass
class Analysis:
    """Results, the tickers without any, and where results are kept, how many tickers were asked for and had a record."""

    results: DataFrame
    missing: DataFrame
    seen: tuple[int, int] | None = None

    @property
    def missing_count(self) -> int:
        """Known from the run that made the results; where they weren't kept, the tickers are counted."""
        if self.seen is not None:
            n = self.seen[0] - self.seen[1]
        else:
            with progress(self.missing.sparkSession, "tickers without data"):
                n = self.missing.count()
        if n:
            logger.warning("no data for %d tickers", n)
        return n

    @property
    def notes(self) -> DataFrame:
        return report.notes(self.results, self.missing_count)

    @property
    def longs(self) -> DataFrame:
        return report.longs(self.results)

    @property
    def shorts(self) -> DataFrame:
        return report.shorts(self.results)

    @property
    def errors(self) -> DataFrame:
        return report.errors(self.results)

    @property
    def counts(self) -> DataFrame:
        return report.signal_counts(self.results, self.missing_count)

    @property
    def metrics(self) -> DataFrame:
        return report.metrics(self.results, self.missing_count)

    @property
    def by_sector(self) -> DataFrame:
        return report.sector_pivot(self.results)


def run(universe: DataFrame, bars: DataFrame, sectors: DataFrame, as_of, align_on: str = "union", model: Model | None = None, keep: bool = True, absent: bool = False, actions: DataFrame | None = None) -> Analysis:
    """Results of a universe as of one date.

    With ``keep`` they are written once, since every report reads them, to the shared folder, where no lost executor takes
    them along; what is counted of the run is observed while it writes. Without it, nothing is computed here.
    With ``actions`` (see ``sources.actions``) bars are adjusted first; that adds no shuffle to the signals' one by ticker.
    Tickers without bars in the range are only counted as missing, or with ``absent`` have ``No Data`` records.
    """
    logger.info("analysis as of %s, dates aligned by %s", as_of, align_on)
    tickers = universe.select("ticker").distinct()
    mine = bars.join(tickers, "ticker", "left_semi")
    if actions is not None:
        mine = adjusted(mine, actions)
    scored = signals(mine, as_of, align_on, model)
    scored = (sig.no_data(universe, scored, as_of) if absent else scored).join(universe, "ticker")
    results = report.ordered(report.results(sector_sources.with_sector(scored, sectors)))
    if not keep:
        return Analysis(results, report.missing_tickers(universe, scored))
    with progress(universe.sparkSession, "analysis"):
        found = Observation("records")
        # observed after the sort, as what comes before it may be computed twice
        numbered = results.observe(found, F.count(F.lit(1)).alias("n")).withColumn("__at", F.monotonically_increasing_id())
        kept = store.save(numbered, "results").orderBy("__at").drop("__at")
        asked, each = universe.agg(F.count(F.lit(1)), F.count_distinct("ticker")).first()
        # a record a ticker, unless the universe repeats some
        seen = (each, found.get["n"] if asked == each else kept.select("ticker").distinct().count())
    return Analysis(kept, report.missing_tickers(universe, kept), seen)
