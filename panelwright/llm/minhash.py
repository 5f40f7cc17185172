"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of five words (A-Z lower-cased, split at 0x20 and 0x09-0x0D)
as 64-bit hashes; with fewer words the whole sequence is one shingle; without words the set is empty and
the document is linked with nothing. K minima of multiplied hashes give a signature of B low bits of each
minimum; the first BANDED of them give bands of ROWS minima each, whose hashes bring candidates together.
For a candidate pair the number of equal signature fields m estimates the similarity, corrected for chance
agreement, as (m / K - 2**-B) / (1 - 2**-B); pairs whose estimate is within SLACK standard deviations of
the threshold or above are confirmed on the full sets. A pair at the threshold of 0.75 shares no band with
probability 5e-6.

Pairs within a group of copies are never all listed:

1. documents with equal sets are one representative (the smallest id) and links to it. Equal sets are told by
   the SHA-256 of all their sorted hashes, a digest; all other links are confirmed on the sets themselves;
2. in each band bucket every document is paired with the bucket's smallest id only, confirmed, and the
   links give first components;
3. of a bucket only documents of different components still have to be compared. Its largest component
   stands on one side: its documents are compared with the others only, and the others with each other
   (of a bucket of up to BLOCK documents all are compared at once). Both sides are cut into blocks of BLOCK
   documents; each pair of blocks is compared by bit counts in one task, and only pairs of different components
   that the estimate lets through are confirmed. A document meets its signature once, and goes to its blocks
   from there. So no link between components is missed, however large the bucket, and one stranger in a
   bucket of copies costs one comparison a copy.

Texts travel only for documents in candidate pairs; their ids are sent to the scan where their measured
number allows it. A leader's partners are spread over slots of SLOT.

Edge cases: null or empty texts have n_shingles 0 and their own id as component. A null id: component
null, kept. Rows that repeat an id are one document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.base import BROADCAST_ROWS, Scratch, batch_word_hashes, batches_of, components, join_measured, mix64, portions

WORDS, PERCENT = 5, 75
K, BANDED, ROWS, BITS = 1024, 128, 4, 2
BLOCK, SLOT = 8192, 512
#: Texts that a confirming task takes at once.
TEXTS = 256
#: Standard deviations of the number of equal fields that the estimate may fall short of the threshold.
SLACK = 5.0
_LONGS = K * BITS // 64
_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(0, 1 << 32, K, np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, K, np.uint32)
_PLACE = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 64, (BANDED // ROWS, ROWS), np.uint64) | np.uint64(1)
_EVEN = np.uint64(0x5555555555555555)


#: Longs of a signature that are compared first where many pairs meet.
_FIRST = 4


def least_equal(fields: int = K) -> int:
    """Equal signature fields below which a pair is taken to be under the threshold."""
    p = 2.0**-BITS + (1 - 2.0**-BITS) * PERCENT / 100
    return int(np.floor(fields * p - SLACK * np.sqrt(fields * p * (1 - p))))


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, part in portions(texts):
        h, bounds = batch_word_hashes(part)
        n = max(len(h) - WORDS + 1, 0)
        full = np.zeros(n, np.uint64)
        for k in range(WORDS):
            full += h[k : k + n] * _PLACE[k]
        full = mix64(full)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                s = np.sort(full[a : b - WORDS + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix64(np.array([(h[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield h[:0]


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(K, np.iinfo(np.uint32).max, np.uint32)
    short = s.astype(np.uint32)
    for at in range(0, len(s), 512):
        x = short[None, at : at + 512] * _MULTIPLY[:, None]
        x += _ADD[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum (from the fifth on: the lowest ones depend on few bits of the shingle), packed into longs."""
    low = ((m >> np.uint32(4)) & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(_LONGS, -1)
    return (low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def equal_fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal 2-bit fields of packed signatures; the last axis holds the longs."""
    x = a ^ b
    return 32 * x.shape[-1] - np.bitwise_count((x | (x >> np.uint64(1))) & _EVEN).sum(axis=-1, dtype=np.int64)


def _sketch(batches):
    for pdf in batches:
        rows = {"doc_id": pdf["doc_id"], "n": [], "mark": [], "sig": [], "bands": []}
        for s in shingle_sets(pdf["text"]):
            rows["n"].append(len(s))
            rows["mark"].append(hashlib.sha256(s.tobytes()).digest())
            m = minima(s)
            rows["sig"].append(pack(m).view(np.int64) if len(s) else None)
            banded = m[:BANDED].astype(np.uint64).reshape(-1, ROWS) + np.uint64(1)
            rows["bands"].append(mix64((mix64(banded) * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64) if len(s) else None)
        yield pd.DataFrame(rows)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, mark, sig, bands): set size, digest of the set, packed signature, band hashes."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(_sketch, f"doc_id {kind}, n long, mark binary, sig array<long>, bands array<long>")


def _fields(a: str, b: str):
    """Equal signature fields of two array columns, in the JVM."""
    even = F.lit(0x5555555555555555)

    def one(i):
        x = F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(even))

    return F.lit(K) - sum((one(i) for i in range(1, _LONGS)), one(0))


def _confirm_sorted(batches):
    """Rows of a slot come together, the leader first; yields the pairs whose full sets reach the threshold."""
    current, own = None, None
    for pdf in batches:
        found = []
        keys = zip(pdf["grp"], pdf["slot"], pdf["doc_id"], pdf["member"], shingle_sets(pdf["text"]), strict=True)
        for grp, slot, doc, member, s in keys:
            if (grp, slot) != current:
                current, own = (grp, slot), []
            if not member:
                own.append(s)
            elif any(100 * (i := len(np.intersect1d(s, o, assume_unique=True))) >= PERCENT * (len(s) + len(o) - i) and i for o in own):
                found.append((doc, grp))
        yield pd.DataFrame(found, columns=["u", "v"])


def confirm(scratch: Scratch, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of saved ``pairs(u, v)`` those whose full sets reach the threshold."""
    sized = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SLOT).cast("int").alias("slots"))
    slotted = scratch.save(pairs.join(sized, "v").select("u", "v", F.pmod(F.hash("u"), "slots").alias("slot")), "slotted")
    members = slotted.select(F.col("u").alias("doc_id"), F.col("v").alias("grp"), "slot", F.lit(True).alias("member"))
    leaders = slotted.select("v", "slot").distinct().select(F.col("v").alias("doc_id"), F.col("v").alias("grp"), "slot", F.lit(False).alias("member"))
    need = members.union(leaders)
    ids = scratch.save(need.select("doc_id").distinct(), "needed")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if (n := ids.count()) <= BROADCAST_ROWS:  # else the join below is the only filter
        texts = join_measured(texts, ids, "doc_id", "left_semi", n)
    texts = texts.join(need.hint("merge"), "doc_id")
    ready = texts.repartition("grp", "slot").sortWithinPartitions("grp", "slot", "member")
    kind = dict(need.dtypes)["doc_id"]
    with batches_of(scratch.spark, TEXTS):
        return scratch.save(ready.mapInPandas(_confirm_sorted, f"u {kind}, v {kind}"), "links")


def _bucket_pairs(batches):
    """Rows sorted by (key, kind, i, j): candidates between different components of one bucket's pair of blocks.

    Of kind 0 both blocks are of the others; of kind 1 block i is of the others and j of the largest component;
    of kind 2 the only block holds all.
    """
    least, first, held, current = least_equal(), least_equal(32 * _FIRST), [], None
    tile = ["key", "kind", "i", "j"]

    def compare(rows: pd.DataFrame):
        kind, i, j = (int(rows[c].iloc[0]) for c in ("kind", "i", "j"))
        ids, comp, block, side = rows["doc_id"].to_numpy(), rows["comp"].to_numpy(), rows["block"].to_numpy(), rows["side"].to_numpy()
        sig = np.stack(rows["sig"].to_numpy()).view(np.uint64)
        bands = np.stack(rows["bands"].to_numpy())
        left, right = (np.arange(len(ids)),) * 2 if kind == 2 else (np.flatnonzero((block == i) & (side == 0)), np.flatnonzero((block == j) & (side == kind)))
        for at in range(0, len(left), 256):
            rows_l = left[at : at + 256]
            hit = equal_fields(sig[rows_l][:, None, :_FIRST], sig[right][None, :, :_FIRST]) >= first
            a, b = np.nonzero(hit & (comp[rows_l][:, None] != comp[right][None, :]))
            if not len(a):
                continue
            parts = [slice(k, k + 65536) for k in range(0, len(a), 65536)]
            near = np.concatenate([equal_fields(sig[rows_l[a[k]]], sig[right[b[k]]]) >= least for k in parts])
            a, b = a[near], b[near]
            shared = bands[rows_l[a]] == bands[right[b]]
            first_shared = bands[rows_l[a], shared.argmax(axis=1)] == rows["key"].iloc[0] if len(a) else a > 0
            a, b = a[first_shared], b[first_shared]  # of all buckets that a pair shares, the first one reports it
            u, v = ids[rows_l[a]], ids[right[b]]
            if len(u):
                yield pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).drop_duplicates()

    for pdf in batches:
        starts = np.flatnonzero((pdf[tile] != pdf[tile].shift()).any(axis=1))
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            key = tuple(pdf[tile].iloc[a])
            if key != current:
                if held:
                    yield from compare(pd.concat(held))
                held, current = [], key
            held.append(pdf.iloc[a:b])
    if held:
        yield from compare(pd.concat(held))


def _cross(bands: DataFrame, comps: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidates between different components within each bucket."""
    labelled = bands.join(comps.select(F.col("node").alias("doc_id"), F.col("label")), "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("comp"))
    sizes = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = labelled.join(open_.select("key", "big", (F.col("n") <= BLOCK).alias("small"), blocks(F.col("n") - F.col("most")).alias("others"), blocks(F.col("most")).alias("bigs")), "key")
    rows = rows.withColumn("side", (F.col("comp") == F.col("big")).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.hash("doc_id"), F.when(F.col("side") == 1, F.col("bigs")).otherwise(F.col("others"))))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    trip = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("block")
    with_others = F.transform(every("others"), lambda o: trip(0, F.least(own, o), F.greatest(own, o)))
    with_big = F.transform(every("bigs"), lambda o: trip(1, own, o))
    of_big = F.transform(every("others"), lambda o: trip(1, o, own))
    trips = F.when(F.col("small"), F.array(trip(2, F.lit(0), F.lit(0)))).when(F.col("side") == 1, of_big).otherwise(F.concat(with_others, with_big))
    # a document meets its signature once, with all of its buckets (at most one a band), and goes to their tiles from there
    own_buckets = rows.select("doc_id", F.struct("key", "comp", "side", "block", trips.alias("trips")).alias("b")).groupBy("doc_id").agg(F.collect_list("b").alias("b"))
    rows = own_buckets.join(reps, "doc_id").select("doc_id", "sig", "bands", F.explode("b").alias("b")).select("doc_id", "sig", "bands", "b.key", "b.comp", "b.side", "b.block", F.explode("b.trips").alias("t"))
    rows = rows.select("key", "doc_id", "comp", "side", "block", "t.kind", "t.i", "t.j", "sig", "bands")
    kind = dict(rows.dtypes)["doc_id"]
    tile = ["key", "kind", "i", "j"]
    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInPandas(_bucket_pairs, f"u {kind}, v {kind}").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.save(sketches(docs), "sketches")
    full = sketched.where("n > 0 and doc_id is not null")
    # written out, so that the join below is between two shuffles and a large group of copies can be split
    firsts = scratch.save(full.groupBy("mark").agg(F.min("doc_id").alias("rep")), "firsts")
    copies = scratch.save(full.select("doc_id", "mark").join(firsts, "mark").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "copies")
    chosen = full.join(firsts.select("mark", F.col("rep").alias("doc_id")), ["mark", "doc_id"], "left_semi").dropDuplicates(["mark"])
    reps = scratch.save(chosen.select("doc_id", "sig", "bands"), "reps")
    bands = reps.select("doc_id", F.explode("bands").alias("key"))
    leaders = bands.groupBy("key").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("w")).where("v <> w").select("key", "v")
    # only rows of buckets with several documents matter from here on
    shared = scratch.save(bands.join(leaders, "key").select("key", "doc_id", "v"), "buckets")
    pairs = shared.where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()
    pairs = pairs.join(reps.select(F.col("doc_id").alias("u"), F.col("sig").alias("su")), "u").join(reps.select(F.col("doc_id").alias("v"), F.col("sig").alias("sv")), "v")
    stars = scratch.save(pairs.where(_fields("su", "sv") >= least_equal()).select("u", "v"), "stars")
    links = confirm(scratch, docs, stars)
    comps = components(scratch, links, "star")
    scratch.release()
    cross = scratch.save(_cross(shared.select("key", "doc_id"), comps, reps), "cross")
    more = confirm(scratch, docs, cross)
    edges = comps.select(F.col("node").alias("u"), F.col("label").alias("v")).union(more).union(copies)
    final = components(scratch, edges, "final").select(F.col("node").alias("doc_id"), "label")
    scratch.release()
    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of ``near_duplicates``: all pairs that share a shingle, and the closure of their links."""
    return rf"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from {docs}),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' '))) end as s from words),
sizes as (select doc_id, len(s)::bigint as n from sets),
shingles as (select doc_id, unnest(s) as g from sets),
common as (select a.doc_id as u, b.doc_id as v, count(*) as i from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all),
pairs as (select u, v from common join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * i >= {PERCENT} * (x.n + y.n - i)),
links as (select u, v from pairs union all select v, u from pairs),
reach(id, low) as (select u, v from links union select r.id, l.v from reach r join links l on r.low = l.u),
lows as (select id, min(low) as low from reach group by id)
select doc_id, n as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, doc_id <= coalesce(low, doc_id) as kept
from sizes left join lows on id = doc_id
"""
