"""The ticker-to-sector dimension: reading, defaulting, delta, upsert and replacement of the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.params import OTHER_SECTOR
from panelwright.schema import SECTORS
from panelwright.sources.snapshots import Snapshots


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, or an empty one if there is none."""
    _, folder = Snapshots(spark, path).latest()
    if folder is None:
        return spark.createDataFrame([], SECTORS)
    return spark.read.parquet(folder).select("ticker", "sector")


def one_each(sectors: DataFrame) -> DataFrame:
    """One row a ticker: of several the first sector by name that isn't empty. Rows without a ticker are dropped."""
    named = F.nullif("sector", F.lit(""))
    return sectors.where("ticker is not null").groupBy("ticker").agg(F.min(named).alias("sector"))


def store(sectors: DataFrame, path: str) -> None:
    """Replaces the stored table, which ``sectors`` may be derived from, by one with a row a ticker (see ``snapshots``)."""
    Snapshots(sectors.sparkSession, path).replace(one_each(sectors.select("ticker", "sector")))


def store_refreshed(universe: DataFrame, source: DataFrame, path: str) -> None:
    """Adds the universe's missing tickers to the stored table; writers at the same time lose nothing of each other's."""
    spark = universe.sparkSession

    def make(old: DataFrame | None) -> DataFrame:
        sectors = spark.createDataFrame([], SECTORS) if old is None else old.select("ticker", "sector")
        return one_each(refresh(universe, sectors, source))

    Snapshots(spark, path).change(make)


def missing(universe: DataFrame, sectors: DataFrame) -> DataFrame:
    """Tickers of the universe without a stored sector."""
    return universe.select("ticker").distinct().join(sectors, "ticker", "left_anti")


def look_up(tickers: DataFrame, source: DataFrame) -> DataFrame:
    """(ticker, sector) from a source table; null, empty or absent sectors are ``Other``; ``one_each`` of repeated tickers counts."""
    found = tickers.join(one_each(source.select("ticker", "sector")), "ticker", "left")
    return found.select("ticker", F.coalesce(F.nullif("sector", F.lit("")), F.lit(OTHER_SECTOR)).alias("sector"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old table with the new rows, which win."""
    return old.join(new, "ticker", "left_anti").unionByName(new)


def refresh(universe: DataFrame, sectors: DataFrame, source: DataFrame) -> DataFrame:
    """The table with the universe's missing tickers looked up."""
    return upsert(sectors, look_up(missing(universe, sectors), source))


def with_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """``rows`` with their sector, ``Other`` where none is stored; ``sectors`` has one row a ticker, as ``store`` leaves it.

    Spark broadcasts the dimension if its size allows.
    """
    joined = rows.join(sectors.select("ticker", "sector"), "ticker", "left")
    return joined.withColumn("sector", F.coalesce("sector", F.lit(OTHER_SECTOR)))
