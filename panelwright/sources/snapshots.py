"""Tables that are replaced whole: versioned snapshots, and pointers published only if absent.

A table is a folder. Each write puts a whole snapshot under ``versions`` and then publishes it as the next
number under ``current``, by a step that fails if that number is there. Readers take the snapshot of the highest
number, so they see a whole table at any time, whichever driver is lost when; two writers publish two
numbers. The last KEEP snapshots stay, for readers that have begun.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEEP = 3
#: Times that a change is made anew because another writer came first.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer published first, each time."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        root = self._path(path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(root).toString().rstrip("/")

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/current")
        if not self._fs.exists(folder):
            return []
        return sorted(int(m[1]) for s in self._fs.listStatus(folder) if (m := re.fullmatch(r"(\d+)", s.getPath().getName())))

    def latest(self) -> tuple[int, str | None]:
        """(number, folder of the snapshot) of the newest table; (0, None) if there is none."""
        for number in reversed(self._numbers()):
            stream = self._fs.open(self._path(f"{self.root}/current/{number}"))
            try:
                name = bytes(stream.readAllBytes()).decode().strip()
            finally:
                stream.close()
            return number, f"{self.root}/versions/{name}"
        return 0, None

    def write(self, df: DataFrame) -> str:
        """Writes a snapshot that nothing points to yet; its name."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/versions/{name}")
        return name

    def publish(self, name: str, number: int) -> bool:
        """Makes a snapshot the table's ``number``; False if that number is taken. Whole or not at all, on plain files and on HDFS."""
        folder, target = f"{self.root}/current", f"{self.root}/current/{number}"
        self._fs.mkdirs(self._path(folder))
        aside = f"{folder}/.{name}.{number}"
        stream = self._fs.create(self._path(aside), True)
        stream.write(bytearray(name.encode()))
        stream.close()
        try:
            if m := re.match(r"file:(?://)?(/.*)", self.root):  # a rename would replace a file there, a link doesn't
                try:
                    os.link(f"{m[1]}/current/.{name}.{number}", f"{m[1]}/current/{number}")
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(self._path(target)) and self._fs.rename(self._path(aside), self._path(target))
        finally:
            self._fs.delete(self._path(aside), False)

    def clean(self) -> None:
        """Deletes what is older than the last KEEP snapshots."""
        for number in self._numbers()[:-KEEP]:
            pointer = self._path(f"{self.root}/current/{number}")
            stream = self._fs.open(pointer)
            name = bytes(stream.readAllBytes()).decode().strip()
            stream.close()
            self._fs.delete(self._path(f"{self.root}/versions/{name}"), True)
            self._fs.delete(pointer, False)

    def replace(self, df: DataFrame) -> int:
        """Writes the table anew, whatever it was; the number it has now."""
        name = self.write(df)
        for _ in range(ATTEMPTS):
            number = self.latest()[0] + 1
            if self.publish(name, number):
                self.clean()
                return number
        raise Conflict(self.root)

    def change(self, make: Callable[[DataFrame | None], DataFrame]) -> int:
        """Replaces the table by what ``make`` makes of it, of the newest one even if others write: no change is lost."""
        for _ in range(ATTEMPTS):
            number, folder = self.latest()
            name = self.write(make(self.spark.read.parquet(folder) if folder else None))
            if self.publish(name, number + 1):
                self.clean()
                return number + 1
            self._fs.delete(self._path(f"{self.root}/versions/{name}"), True)
        raise Conflict(self.root)
