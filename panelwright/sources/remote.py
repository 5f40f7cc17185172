"""Records by request: a data source over a store of CSV parts, read by URL with timeouts and bounded retries.

A store is a folder, on a web server or a file system, of CSV files with a header, and ``parts.csv``, which has
for each of them its name and the first and last key in it. A read asks for a part at a time:

    spark.dataSource.register(remote.Records)
    spark.read.format("panelwright_records").option("url", "https://.../sectors").option("key", "ticker")
        .schema("ticker string, sector string").load().where(...)

Parts are the partitions. The options ``first`` and ``last`` bound the keys of the parts that are asked for. With
``push=true``, in sessions with ``spark.sql.python.filterPushdown.enabled``, filters on the key, as far as they are equalities,
sets or bounds, leave out parts in the same way; this is for tables that are loaded for one query, since Spark 4.1
keeps the filters of a loaded table's first plan for its later ones. Either way a part has other keys too: rows
are for ``where`` to choose. A part that fails is asked for again, ``retries`` times,
with a growing pause; then it is an error, or with ``onfail=skip`` a warning and no rows, so that what it would
have had gets the default of whoever looks it up (``Other`` for sectors).

Edge cases: a store without parts has no rows; absent columns and empty fields are NULL; columns that the schema doesn't name
are left out; text is UTF-8.
"""

from __future__ import annotations

import csv
import io
import logging
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

logger = logging.getLogger("panelwright")
NAME = "panelwright_records"
TIMEOUT, RETRIES, PAUSE = 10.0, 3, 0.5
LIST = "parts.csv"


def fetch(url: str, timeout: float = TIMEOUT) -> bytes:
    """What is at a URL: of web servers directly, of other stores through pyarrow's file systems."""
    if re.match("https?://", url):
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.read()
    if m := re.match(r"(?:file:(?://)?)?(/.*)", url):
        with open(m[1], "rb") as f:
            return f.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    with system.open_input_file(path) as f:
        return f.read()


def fetch_again(url: str, timeout: float, retries: int, pause: float) -> bytes:
    """``fetch``, up to ``retries`` times more with doubled pauses. What a server says isn't there is not asked for again."""
    for attempt in range(retries + 1):
        try:
            return fetch(url, timeout)
        except OSError as e:  # URLError, timeouts and file errors are among these
            if attempt == retries or isinstance(e, urllib.error.HTTPError) and e.code in (401, 403, 404, 410):
                raise
            logger.warning("%s: %s, asking again", url, e)
            time.sleep(pause * 2**attempt)
    raise AssertionError


@dataclass
class Part(InputPartition):
    name: str


class RecordReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        if odd := [f.name for f in schema.fields if f.dataType.simpleString() != "string"]:
            raise ValueError(f"records are text; cast {odd} afterwards")
        self.url, self.key = options["url"].rstrip("/"), options.get("key", "ticker")
        self.timeout, self.retries, self.pause = float(options.get("timeout", TIMEOUT)), int(options.get("retries", RETRIES)), float(options.get("pause", PAUSE))
        self.skip = options.get("onfail", "error") == "skip"
        asked = ((GreaterThanOrEqual, options.get("first")), (LessThanOrEqual, options.get("last")))
        self.wanted: list[Filter] = [kind((self.key,), value) for kind, value in asked if value is not None]

    def may_hold(self, first: str, last: str) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, In):
                return any(v is not None and first <= v <= last for v in f.value)
            if f.value is None:
                return False
            if isinstance(f, EqualTo):
                return first <= f.value <= last
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                return last >= f.value
            return first <= f.value

        return all(one(f) for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        listed = fetch_again(f"{self.url}/{LIST}", self.timeout, self.retries, self.pause).decode()
        parts = list(csv.DictReader(io.StringIO(listed)))
        return [Part(p["name"]) for p in parts if self.may_hold(p["first"], p["last"])]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition is None or getattr(partition, "name", None) is None:  # no parts: Spark asks for one all the same
            return
        try:
            text = fetch_again(f"{self.url}/{partition.name}", self.timeout, self.retries, self.pause).decode()
        except OSError as e:
            if not self.skip:
                raise
            logger.warning("%s of %s left out: %s", partition.name, self.url, e)
            return
        for row in csv.DictReader(io.StringIO(text)):
            yield tuple(row.get(n) or None for n in self.names)


class FilteringReader(RecordReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.key,):
                self.wanted.append(f)
            yield f  # parts hold other keys too, so Spark has to look at the rows


class Records(DataSource):
    """The data source; register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "ticker string, sector string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("push") == "true" else RecordReader)(schema, self.options)


def records(spark: SparkSession, url: str, schema: str, key: str, **options) -> DataFrame:
    """The records of a store; further options are those of the source: first, last, push, timeout, retries, pause, onfail."""
    spark.dataSource.register(Records)
    reader = spark.read.format(NAME).schema(schema).option("url", url).option("key", key)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def write_store(rows: DataFrame, url: str, key: str, parts: int) -> None:
    """Writes rows of text as a store of about so many parts, by ranges of the key; rows without a key are left out."""
    spark = rows.sparkSession
    text = rows.where(F.col(key).isNotNull()).select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    folder = url.rstrip("/")
    text.repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    # one row a part comes to the driver
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(text.schema).csv(folder)
    found = back.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    out = io.StringIO()
    lines = csv.writer(out, lineterminator="\n")
    lines.writerow(("name", "first", "last"))
    lines.writerows(sorted(tuple(r) for r in found))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{LIST}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(out.getvalue().encode()))
    stream.close()
