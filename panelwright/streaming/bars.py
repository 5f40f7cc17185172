"""Streaming bars: an extension that turns a stream of trades into bars with the same fields.

Late trades are taken until the watermark passes; a bar is emitted once, when its window closes, so the
state holds open windows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, every: str = "1 day", late: str = "1 day", price: str = "value", ticker: str = "event_type", ts: str = "ts") -> DataFrame:
    """(ticker, bar_start, open, high, low, close, volume) of tumbling windows over ``trades``, streaming or not.

    Open and close are those of the earliest and latest trade, equal times by price; volume counts trades.
    """
    t = trades.select(F.col(ticker).cast("string").alias("ticker"), F.col(ts).cast("timestamp").alias("ts"), F.col(price).cast("double").alias("price")).where("price is not null and ts is not null")
    if trades.isStreaming:
        t = t.withWatermark("ts", late)
    at = F.struct("ts", "price")
    out = t.groupBy(F.window("ts", every).alias("w"), "ticker").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return out.select("ticker", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def read_events(spark, folder: str, schema) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def write_bars(bars: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Starts the query that appends closed bars to a Parquet folder."""
    writer = bars.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
