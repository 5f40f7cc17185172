"""Shared pieces: tables in the cluster's shared folder, connected components, 64-bit word hashes."""

from __future__ import annotations

import os
import re
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.store import shared_folder

#: Rows of (id, few numbers) that may be broadcast once their count has been measured.
BROADCAST_ROWS = 200_000


class Scratch:
    """Tables written to the folder that driver and executors share (``spark.checkpoint.dir``).

    Writing a table and reading it again cuts the lineage without relying on any executor's disk.
    See ``store.shared_folder`` for sessions without that setting.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = shared_folder(spark)
        self.root = f"{root.rstrip('/')}/panelwright-{uuid.uuid4().hex}"
        self._delete_on_exit(self.root)

    def _path(self, uri: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete_on_exit(self, uri: str) -> None:
        path, fs = self._path(uri)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def folder(self, name: str) -> str:
        """A new empty shared folder, as a URI."""
        uri = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        path, fs = self._path(uri)
        fs.mkdirs(path)
        return fs.makeQualified(path).toString()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        uri = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(uri)
        out = self.spark.read.schema(df.schema).parquet(uri)
        out._scratch = uri  # noqa: SLF001
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        path, fs = self._path(df._scratch)  # noqa: SLF001
        fs.delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is written within: long texts meet whole batches of their like."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of whole texts in an Arrow batch.
TEXT_ROWS = 1280


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to TEXT_ROWS: 10,000 whole texts are held several times over in JVM and worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def join_measured(big: DataFrame, small: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join; the small side is broadcast only if its measured count is within BROADCAST_ROWS."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)``: one row ``(node, label)`` per endpoint, label = the smallest node.

    Each round hangs every node under its smallest neighbour, follows the pointers twice and contracts
    the edges, so the number of live edges falls geometrically. Only per-node minima are aggregated:
    a node with any number of neighbours is split over tasks by the partial aggregation.
    """
    live = scratch.save(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), f"{name}-edges")
    labels = scratch.save(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label")), f"{name}-labels")
    while not live.isEmpty():
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = scratch.save(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), f"{name}-up")
        for _ in range(2):
            above = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.save(up.join(above, "p").select("u", F.col("pp").alias("p")), f"{name}-up")
            scratch.drop(up)
            up = jumped
        to = up.select(F.col("u").alias("label"), "p")
        new_labels = scratch.save(labels.join(to, "label", "left").select("node", F.coalesce("p", "label").alias("label")), f"{name}-labels")
        ends = live.join(up.select("u", F.col("p").alias("pu")), "u").select("pu", "v")
        ends = ends.join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv")
        new_live = scratch.save(ends.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), f"{name}-edges")
        for old in (live, labels, up):
            scratch.drop(old)
        live, labels = new_live, new_labels
    scratch.drop(live)
    return labels


# ---------------------------------------------------------------- files in a shared folder


#: Bytes of files of remote stores that a worker holds; files are read again beyond that.
HELD = 512 << 20
_held: dict[str, np.ndarray] = {}


class Files:
    """Reading ranges and writing files by URI: plain files directly, other stores through pyarrow."""

    def __init__(self, uri: str):
        m = re.match(r"(?:file:)(?://)?(/.*)", uri)
        self.local = m is not None or uri.startswith("/")
        self._root = (m[1] if m else uri) if self.local else uri
        self._open: dict = {}
        if not self.local:
            from pyarrow import fs

            self._fs, self._root = fs.FileSystem.from_uri(uri)

    def create(self, name: str):
        path = f"{self._root}/{name}"
        return open(path, "wb") if self.local else self._fs.open_output_stream(path)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self._open:
            if len(self._open) >= 128:
                self.close()
            path = f"{self._root}/{name}"
            self._open[name] = open(path, "rb", buffering=0) if self.local else self._fs.open_input_file(path)
        f = self._open[name]
        return os.pread(f.fileno(), length, offset) if self.local else f.read_at(length, offset)

    def bytes(self, name: str) -> np.ndarray:
        """A whole file: memory-mapped where it is a plain file, else read and held while HELD bytes allow."""
        if self.local:
            return np.asarray(np.memmap(f"{self._root}/{name}", np.uint8, "r"))
        path = f"{self._root}/{name}"
        if path not in _held:
            with self._fs.open_input_file(path) as f:
                data = np.frombuffer(f.read(), np.uint8)
            while _held and sum(map(len, _held.values())) + len(data) > HELD:
                del _held[next(iter(_held))]
            _held[path] = data
        _held[path] = _held.pop(path)  # the least recently used comes first
        return _held[path]

    def close(self) -> None:
        for f in self._open.values():
            f.close()
        self._open = {}


# ---------------------------------------------------------------- 64-bit hashes of words, vectorised

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at once; a longer text is cut between words.
SEGMENT = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random number for each byte at each of a word's first places.
_PLACES = 256
_TABLE = mix64(mix64(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _segment_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is the scrambled sum of one random number per (place in the word, byte).

    A polynomial modulo 2**64 would do with less, but its words of 1,024 letters can collide by
    construction (Thue-Morse words); sums of unrelated numbers have no such structure.
    """
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    # what the white space after a word adds is outside the sums
    place = np.arange(len(a), dtype=np.int32)
    place -= np.repeat(np.concatenate(([0], start)).astype(np.int32), np.diff(start, prepend=0, append=len(a)))
    code = np.minimum(place, _PLACES - 1)
    code <<= 8
    code |= _LOWER[a]
    value = _TABLE.take(code)
    if (end - start).max() > _PLACES:
        far = np.flatnonzero((place >= _PLACES) & ~space)
        value[far] = mix64(mix64(place[far].astype(np.uint64) * np.uint64(256) + _LOWER[a[far]] + np.uint64(0x9E3779B97F4A7C15)))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix64(total[end] - total[start]), start


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, byte offset) of each maximal run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= SEGMENT:
        return _segment_hashes(a)
    hashes, starts, at = [], [], 0
    while at < len(a):
        end = min(at + SEGMENT, len(a))
        if end < len(a):
            step = SEGMENT
            while not (gaps := np.flatnonzero(_SPACE[a[end : end + step]])).size and end + step < len(a):
                step *= 2
            end = end + int(gaps[0]) if gaps.size else len(a)
        h, s = _segment_hashes(a[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def portions(texts, characters: int = 1 << 20):
    """(index of the first, texts) in runs of about so many characters, so that arrays over a run stay small."""
    at, size, part = 0, 0, []
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= characters:
            yield at, part
            at, size, part = at + len(part), 0, []
    if part:
        yield at, part


def batch_word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts (None counts as empty): (hashes, bounds); text i owns bounds[i]:bounds[i+1]."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, counts, group, size = [], [], [], 0

    def flush():
        nonlocal group, size
        if group:
            h, s = word_hashes(b"\n".join(group) + b"\n")
            ends = np.cumsum([len(p) + 1 for p in group])
            counts.append(np.diff(np.searchsorted(s, ends), prepend=0))
            hashes.append(h)
        group, size = [], 0

    for p in parts:
        if size and size + len(p) >= SEGMENT:
            flush()
        group.append(p)
        size += len(p) + 1
    flush()
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(n))).astype(np.int64)
