"""WARC archives with a two-level capture index.

Writing: each task appends its records to one archive file in a shared folder, every record its own gzip
member, and returns where each capture lies. Of records with equal payloads (at least REVISIT_BYTES
long) the one with the smallest id is a response and the others are revisits that refer to it.

Index: captures are sorted by a key, the reversed host and path of the URL followed by the capture's id.
BLOCK captures at a time are compressed into one block of an index shard; a sparse directory keeps each
block's first key, shard file, offset and length. A lookup finds the block by binary search in the
directory, reads that range of the shard, finds the capture by binary search in the block and reads the
record's range of the archive.

The directory has one row per BLOCK captures and is itself cut by key range: a lookup task reads the part
that its own keys need. Files are named after the task's attempt; a lost or repeated attempt leaves a file
that nothing refers to.

Edge cases: a null or empty html has an empty payload; a null url is an empty key; every row has a record
and a result row, since a key ends with the capture's running number: equal urls, repeated rows and rows that
repeat an id with other contents are captures of their own. Rows without an id are archived under an empty
one; they refer to the smallest id with their payload, and are responses if there is none. Rows that repeat
the smallest id of a payload are all responses. An empty table has no archives and no index. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.base import Files, Scratch

REVISIT_BYTES = 0
#: Captures in a block of the index.
BLOCK = 512
_LEVEL = 1
#: A record's date; a capture table without times has this one.
DATE = "1970-01-01T00:00:00Z"


# ---------------------------------------------------------------- records


def capture_key(url: str | None, run: int) -> str:
    """Reversed host, path and query, then the capture's running number, padded so that text order is numeric order."""
    text = (url or "").strip()
    parts = urlsplit(text if "//" in text else f"//{text}") if _parses(text) else None
    if parts is None:
        surt = text.lower()
    else:
        host = ",".join(reversed((parts.hostname or "").split(".")))
        surt = f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    return f"{surt.replace(chr(9), '%09').replace(chr(10), '%0A').replace(' ', '%20')} {run:020d}"


def _parses(text: str) -> bool:
    try:
        urlsplit(text if "//" in text else f"//{text}").hostname  # noqa: B018
        return True
    except ValueError:
        return False


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(x: str) -> str:
    return re.sub(r"[\r\n]+", " ", x)


def record(capture_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit without it."""
    capture_id = "" if capture_id is None else capture_id
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:capture:{capture_id}>",
        f"WARC-Target-URI: {_header_value(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:capture:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:] if ": " in line), payload


# ---------------------------------------------------------------- writing archives


def _write(folder: str):
    def run(batches):
        files, out, name, at = Files(folder), None, f"{uuid.uuid4().hex}.warc.gz", 0
        for pdf in batches:
            rows = []
            for run, i, url, html, first in zip(*(pdf[c] for c in ("run", "page_id", "url", "html", "first_id")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                i, refers = (None if pd.isna(x) else int(x) for x in (i, first))
                member = zlib.compress(record(i, url, payload, payload_digest(payload), refers), _LEVEL, 31)
                out = out or files.create(name)
                out.write(member)
                rows.append((capture_key(url, run), name, at, len(member)))
                at += len(member)
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])
        if out:
            out.close()

    return run


def write_archives(scratch: Scratch, pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html)``; returns the captures (key, file, offset, length)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("mark")).where(F.octet_length("html") >= revisit_bytes)
    firsts = marked.groupBy("mark").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count_if(F.col("page_id").isNull()).alias("nameless")).where("first_id <> last_id or first_id is not null and nameless > 0")
    revisits = marked.join(firsts, "mark").where("page_id is null or page_id <> first_id").select(F.col("page_id").alias("id"), F.col("mark").alias("of"), "first_id").distinct()
    # an id decides whom it refers to only together with its payload: ids may be repeated
    numbered = rows.withColumns({"run": F.monotonically_increasing_id(), "mark": F.sha1(F.col("html").cast("binary"))})
    joined = numbered.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left")
    return scratch.save(joined.select("run", "page_id", "url", "html", "first_id").mapInPandas(_write(folder), "key string, file string, offset long, length long"), "captures")


# ---------------------------------------------------------------- index


def _write_index(folder: str):
    def run(batches):
        files, out, name, at, held = Files(folder), None, f"{uuid.uuid4().hex}.cdx", 0, []

        def block(lines):
            nonlocal out, at
            out = out or files.create(name)
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            at += len(data)
            return lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], name, at - len(data), len(data), len(lines)

        for pdf in batches:
            held += [f"{k}\t{f}\t{o}\t{n}" for k, f, o, n in zip(pdf["key"], pdf["file"], pdf["offset"], pdf["length"], strict=True)]
            done = [block(held[i : i + BLOCK]) for i in range(0, len(held) - BLOCK + 1, BLOCK)]
            held = held[len(done) * BLOCK :]
            yield pd.DataFrame(done, columns=_DIRECTORY)
        if held:
            yield pd.DataFrame([block(held)], columns=_DIRECTORY)
        if out:
            out.close()

    return run


_DIRECTORY = ["first_key", "last_key", "shard", "offset", "length", "n"]


def write_index(scratch: Scratch, captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures into compressed blocks; returns the sparse directory, one row per block."""
    ordered = captures.repartitionByRange("key").sortWithinPartitions("key")
    return scratch.save(ordered.mapInPandas(_write_index(folder), "first_key string, last_key string, shard string, offset long, length long, n int"), "directory")


class IndexReader:
    """Lookups by capture key through directory, block and archive."""

    def __init__(self, directory: pd.DataFrame, index_folder: str, archive_folder: str):
        d = directory.sort_values("first_key", kind="stable")
        self._firsts, self._where = d["first_key"].tolist(), list(zip(d["shard"], d["offset"], d["length"], strict=True))
        self._index, self._archive = Files(index_folder), Files(archive_folder)
        self._block: tuple[int, list[str], list[str]] = (-1, [], [])

    def _load(self, k: int) -> tuple[list[str], list[str]]:
        if self._block[0] != k:
            lines = zlib.decompress(self._index.read(*self._where[k])).decode("utf-8", "surrogatepass").split("\n")
            self._block = k, [x.split("\t", 1)[0] for x in lines], lines
        return self._block[1:]

    def locate(self, key: str) -> tuple[str, int, int] | None:
        """(archive file, offset, length) of a capture."""
        k = bisect.bisect_right(self._firsts, key) - 1
        if k < 0:
            return None
        keys, lines = self._load(k)
        i = bisect.bisect_left(keys, key)
        if i == len(keys) or keys[i] != key:
            return None
        _, file, offset, length = lines[i].rsplit("\t", 3)
        return file, int(offset), int(length)

    def fetch(self, keys: list[str]) -> list[bytes | None]:
        """The records of keys; ranges are read in the order in which they lie in the archives."""
        places = [self.locate(k) for k in keys]
        out: list[bytes | None] = [None] * len(keys)
        for i in sorted((i for i, p in enumerate(places) if p), key=lambda i: places[i]):
            out[i] = zlib.decompress(self._archive.read(*places[i]), 31)
        return out


def _lookup(index_folder: str, archive_folder: str, with_payload: bool):
    def read(reader, keys):
        rows = []
        for key, data in zip(keys, reader.fetch(keys), strict=True):
            if data is None:
                continue
            fields, http, payload = parse_record(data)
            refers, digest = fields.get("WARC-Refers-To"), fields["WARC-Payload-Digest"][5:]
            if not refers and payload_digest(payload) != digest:
                raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't have its digest")
            rows.append((key, int(name) if (name := fields["WARC-Record-ID"][13:-1]) else None, fields["WARC-Target-URI"], fields["WARC-Type"], digest, int(http["Content-Length"]), int(refers[13:-1]) if refers else None, payload if with_payload and not refers else None))
        return pd.DataFrame(rows, columns=_RECORD).astype({"refers_to": "Int64", "capture_id": "Int64"})

    def run(batches):
        reader, blocks = None, []
        for pdf in batches:  # of a task: its parts of the directory come first, then the keys in order
            directory = pdf["shard"].notna()
            if directory.any():
                blocks.append(pdf.loc[directory, _DIRECTORY].astype({"offset": "int64", "length": "int64"}))
            keys = pdf.loc[~directory, "key"].tolist()
            if keys and reader is None:
                every = pd.concat(blocks) if blocks else pd.DataFrame(columns=_DIRECTORY)
                reader = IndexReader(every.drop_duplicates(["shard", "offset"]), index_folder, archive_folder)
            for at in range(0, len(keys), 256):
                yield read(reader, keys[at : at + 256])

    return run


_RECORD = ["key", "capture_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]


def _deal(cuts: list[str], directory: bool):
    """Adds the parts of the key range that a row belongs to, found by binary search: one for a key, for a block all that it spans."""

    def run(batches):
        for pdf in batches:
            first = [bisect.bisect_right(cuts, k) for k in pdf["first_key" if directory else "key"]]
            pdf["part"] = first
            if directory:
                last = [bisect.bisect_right(cuts, k) for k in pdf["last_key"]]
                pdf["part"] = [list(range(a, b + 1)) for a, b in zip(first, last, strict=True)]
                pdf = pdf.explode("part").astype({"part": "int32"})
            yield pdf

    return run


def read_captures(keys: DataFrame, directory: DataFrame, index_folder: str, archive_folder: str, parts: int, with_payload: bool = True) -> DataFrame:
    """The records of ``keys(key)``, found through the index.

    Keys are looked up block by block of the directory's order: key and directory rows are dealt by key
    range, and a block whose range spans several tasks goes to each of them. The cuts, one a task, come from
    the directory's first keys.
    """
    bounds = directory.select(F.col("first_key").alias("key"))
    cuts = [r[0] for r in bounds.repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("m")).orderBy("m").select("m").limit(parts).collect()][1:]
    null = lambda t: F.lit(None).cast(t)
    fields = "first_key string, last_key string, shard string, offset long, length long, n int, part int"
    dealt = directory.select(*_DIRECTORY).mapInPandas(_deal(cuts, True), fields).withColumns({"kind": F.lit(0), "key": F.col("first_key")})
    empty = {c: null(t) for c, t in zip(_DIRECTORY, ("string", "string", "string", "long", "long", "int"), strict=True)}
    asked = keys.where("key is not null").select("key").mapInPandas(_deal(cuts, False), "key string, part int").withColumns({"kind": F.lit(1), **empty})
    met = dealt.unionByName(asked).repartition(parts, "part").sortWithinPartitions("kind", "key")
    return met.mapInPandas(_lookup(index_folder, archive_folder, with_payload), "key string, capture_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Writes ``pages`` to archives, indexes them and reads every capture back through the index by its key."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    archives, index = scratch.folder("archives"), scratch.folder("index")
    captures = write_archives(scratch, pages, archives)
    directory = write_index(scratch, captures, index)
    return read_captures(captures.select("key"), directory, index, archives, int(spark.conf.get("spark.sql.shuffle.partitions")), with_payload)


def oracle() -> str:
    return """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as hex from p),
f as (select *, min(page_id) over (partition by hex, payload_bytes) as first_id from d)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from f
"""
