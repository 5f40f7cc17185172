"""Universes: symbol lists, index constituents, and their catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.numbering import numbered
from panelwright.schema import UNIVERSE

SUFFIX = ".NS"
# The indices on offer, and the files of their constituents.
INDEX_FILES = {
    "NIFTY 50": "ind_nifty50list.csv",
    "NIFTY NEXT 50": "ind_niftynext50list.csv",
    "NIFTY 100": "ind_nifty100list.csv",
    "NIFTY 200": "ind_nifty200list.csv",
    "NIFTY 500": "ind_nifty500list.csv",
    "NIFTY MIDCAP 50": "ind_niftymidcap50list.csv",
    "NIFTY MIDCAP 100": "ind_niftymidcap100list.csv",
    "NIFTY SMLCAP 100": "ind_niftysmallcap100list.csv",
    "NIFTY BANK": "ind_niftybanklist.csv",
    "NIFTY AUTO": "ind_niftyautolist.csv",
    "NIFTY FIN SERVICE": "ind_niftyfinancelist.csv",
    "NIFTY FMCG": "ind_niftyfmcglist.csv",
    "NIFTY IT": "ind_niftyitlist.csv",
    "NIFTY MEDIA": "ind_niftymedialist.csv",
    "NIFTY METAL": "ind_niftymetallist.csv",
    "NIFTY PHARMA": "ind_niftypharmalist.csv",
}
DEFAULT_INDEX = "NIFTY 500"
KINDS = ("F&O Stocks", "Index Constituents")


class UniverseError(ValueError):
    """A universe that can't be resolved."""


def catalog(spark: SparkSession, root: str = "") -> DataFrame:
    """(index_name, path) of every index under a root folder."""
    return spark.createDataFrame([(k, f"{root}{v}") for k, v in INDEX_FILES.items()], "index_name string, path string")


def index_path(name: str, root: str = "") -> str:
    if name not in INDEX_FILES:
        raise UniverseError(f"no such index: {name}")
    return f"{root}{INDEX_FILES[name]}"


def tickers(symbols: DataFrame, order: list[str] | None = None, suffix: str = SUFFIX) -> DataFrame:
    """(seq, ticker) of a table with a column SYMBOL, symbol or Symbol: blank ones dropped, the suffix added.

    ``seq`` numbers the rows by ``order``, which should tell rows apart; without it rows are numbered as read, which is
    the order of a file. Rows are numbered in ranges (see ``operators.numbering``), not in one task.
    """
    found = next((c for c in ("SYMBOL", "symbol", "Symbol") if c in symbols.columns), None)
    if found is None:
        raise UniverseError(f"no symbol column among {symbols.columns}")
    kept = symbols.withColumn("__at", F.monotonically_increasing_id()).where(F.col(found).isNotNull() & (F.trim(found) != ""))
    by = [F.col(c) for c in order] if order else [F.col("__at")]
    names = kept.select(F.concat(F.col(found).cast("string"), F.lit(suffix)).alias("ticker"), *[c.alias(f"__by{i}") for i, c in enumerate(by)])
    return numbered(names, [f"__by{i}" for i in range(len(by))], "seq").select("seq", "ticker")


def require(universe: DataFrame) -> DataFrame:
    """The universe, or an error if it is empty."""
    if universe.isEmpty():
        raise UniverseError("the universe is empty")
    return universe


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """A symbol list from Parquet or CSV."""
    return tickers(_read(spark, path))


def index_constituents(spark: SparkSession, name: str, root: str) -> DataFrame:
    return tickers(_read(spark, index_path(name, root)))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def resolve(spark: SparkSession, kind: str, index: str = DEFAULT_INDEX, root: str = "", symbols: str = "") -> DataFrame:
    """The universe that the kind names."""
    if kind not in KINDS:
        raise UniverseError(f"no such universe: {kind}")
    return require(symbol_list(spark, symbols) if kind == KINDS[0] else index_constituents(spark, index, root))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], UNIVERSE)
