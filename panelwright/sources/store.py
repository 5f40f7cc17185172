"""Tables that many queries read, written once a session to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from inspect import signature

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, str] = {}
_OWN: dict[str, str] = {}


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may do with a folder of this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="panelwright-")
    return _OWN[sc.applicationId]


def _state(spark: SparkSession, uri: str) -> tuple:
    path, fs = _path(spark, uri)
    return uri, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()


def once(spark: SparkSession, name: str, inputs: list[str], make: Callable) -> str:
    """The path of what is made from the inputs; made again if an input has changed since, or it is gone.

    ``make()`` gives a table, which is written as Parquet; with an argument, ``make(path)`` writes what it makes itself.
    """
    key = (spark.sparkContext.applicationId, name, *(_state(spark, i) for i in inputs))
    known = _WRITTEN.get(key)
    if known:
        path, fs = _path(spark, known)
        if fs.exists(path):
            return known
    uri = f"{shared_folder(spark)}/panelwright-{name}-{uuid.uuid4().hex}"
    path, fs = _path(spark, uri)
    if signature(make).parameters:
        make(uri)
    else:
        make().write.parquet(uri)
    fs.deleteOnExit(path)
    _WRITTEN[key] = uri
    return uri


def save(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder until the session ends and read again: its lineage is cut, no executor's disk is relied on."""
    spark = df.sparkSession
    uri = f"{shared_folder(spark)}/panelwright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    path, fs = _path(spark, uri)
    fs.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(uri)
