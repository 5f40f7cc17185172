"""Grouping of spelling variants by forward and backward automata.

Words at one error from each other are found by halves. Of a word u v, either the error of a near word lies
behind u, which it shares as a prefix, or before v, which it shares as a suffix. The forward automaton of all
words follows u exactly and completes the rest with one error; the backward one, of reversed words, does so
from v. A near word that shares both u and v is left to the forward automaton, so each pair is found once.
Automata number their words (perfect hashing); a number leads to the word and its count.

Words are dealt in their order, and in the order of their reversals, into ranges of about SHARD words; a
range is one automaton, and a word goes to the ranges that its half may lie in, mostly one, found by binary search
among their borders (one row a range on the driver, two words each). No range grows with the data, whatever
prefix many words share. A task sums up what it finds: for each word and range the number of near words and
the best of them; a word has at most a few thousand near words, whatever the number of words.

Words are counted where they are read, up to COUNTED different ones at a time, and summed by one shuffle. Roots
are found by following forms, twice as far in each round; counts at least double along them, so few rounds do.

Edge cases: null and empty texts have no words; a null doc_id counts as empty text in the seeded deletions; repeated
rows count as often as they occur; an empty table has no words; other columns are ignored. Runs are cut nowhere:
a very long text is read in parts that end between runs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.automaton import Automaton
from panelwright.llm.base import TEXT_ROWS, Scratch, batches_of
from panelwright.llm.vectors import runs

LETTERS, LEAST, DROP_EVERY, RATIO = 5, 3, 97, 2
#: Different words that a task counts before it passes them on, characters that it splits at once, words of an automaton.
COUNTED, CHARACTERS, SHARD = 300_000, 1 << 20, 16_384
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {i: i + 32 for i in range(65, 91)}
_FAR = "\U0010ffff"


def word_of(run: str, doc: str, drop_every: int) -> str:
    """The lower-case run; without one character if its seeded draw says so."""
    low = run.translate(_LOWER)
    h = zlib.crc32(f"{doc}:{low}".encode()) if drop_every else 1
    return low if not drop_every or h % drop_every else low[: h % len(low)] + low[h % len(low) + 1 :]


def _count(letters: int, drop_every: int):
    def run(batches):
        counts: Counter = Counter()
        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                if not text:
                    continue
                at = 0
                while at < len(text):
                    gap = _OTHER.search(text, at + CHARACTERS)
                    end = gap.start() if gap else len(text)
                    for found, n in Counter(_RUN.findall(text, at, end)).items():
                        if len(found) >= letters and len(word := word_of(found, doc, drop_every)) >= letters:
                            counts[word] += n
                    at = end
                if len(counts) >= COUNTED:
                    yield pd.DataFrame(counts.items(), columns=["word", "n"])
                    counts.clear()
        yield pd.DataFrame(counts.items(), columns=["word", "n"])

    return run


def words(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): words of at least ``letters`` characters that occur ``least`` times in ``docs(doc_id, text)``."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    found = texts.mapInPandas(_count(letters, drop_every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _half(key: str, backward: bool) -> int:
    """Characters of a key to be matched exactly; the halves of both directions make up the word."""
    return len(key) - len(key) // 2 if backward else len(key) // 2


def _send(firsts: list[str], lasts: list[str], backward: bool):
    """Each key to the ranges in which keys may begin with its half."""

    def run(batches):
        for pdf in batches:
            at, keys = [], []
            for key in pdf["key"]:
                half = key[: _half(key, backward)]
                for shard in range(bisect_left(lasts, half), bisect_right(firsts, half + _FAR)):
                    at.append(shard)
                    keys.append(key)
            yield pd.DataFrame({"shard": at, "key": keys, "n": -1})

    return run


def _match(backward: bool, pairs: bool):
    word = (lambda key: key[::-1]) if backward else (lambda key: key)

    def near(automaton: Automaton, keys: list[str], ns: list[int], key: str):
        half = _half(key, backward)
        for number in automaton.with_one_error(key[:half], key[half:]):
            other = keys[number]
            if not (backward and other.endswith(key[half:])):  # such a one shares the first half too: found forward
                yield word(other), ns[number]

    def run(batches):
        current, automaton, keys, ns = None, None, [], []
        for (shard,), part in runs(batches, ["shard"]):
            if shard != current:
                current, automaton, keys, ns = shard, None, [], []
            members = part["n"].to_numpy() >= 0  # they come before what is sent to the range
            if members.any():
                keys += part["key"][members].tolist()
                ns += part["n"][members].tolist()
            if members.all():
                continue
            automaton = automaton or Automaton(keys)
            out = []
            for key in part["key"][~members]:
                found = list(near(automaton, keys, ns, key))
                if pairs:
                    out += [(word(key), w, n) for w, n in found]
                elif found:
                    best = min(found, key=lambda x: (-x[1], x[0]))
                    out.append((word(key), len(found), *best))
            yield pd.DataFrame(out, columns=["word", "near", "near_n"] if pairs else ["word", "n_near", "near", "near_n"])

    return run


def _found(scratch: Scratch, counted: DataFrame, pairs: bool) -> DataFrame:
    shards = max(1, -(-counted.count() // SHARD))
    parts = []
    for backward in (False, True):
        keys = counted.select((F.reverse("word") if backward else F.col("word")).alias("key"), "n")
        dealt = scratch.save(keys.repartitionByRange(shards, "key").select(F.spark_partition_id().alias("part"), "key", "n"), "ranges")
        borders = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.min("key"), F.max("key")).collect())
        firsts, lasts = [b[1] for b in borders], [b[2] for b in borders]
        number = {b[0]: i for i, b in enumerate(borders)}
        place = F.lit(0) if len(number) < 2 else F.element_at(F.create_map(*[F.lit(x) for p in number.items() for x in p]), F.col("part"))
        members = dealt.select(place.cast("int").alias("shard"), "key", "n")
        asked = dealt.select("key").mapInPandas(_send(firsts, lasts, backward), "shard int, key string, n long")
        met = members.union(asked).repartition("shard").sortWithinPartitions("shard", F.col("n") < 0, "key")
        parts.append(met.mapInPandas(_match(backward, pairs), "word string, near string, near_n long" if pairs else "word string, n_near long, near string, near_n long"))
    return parts[0].union(parts[1])


def near_pairs(counted: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of ``counted(word, n)`` that differ by exactly one character inserted, deleted or replaced."""
    scratch = Scratch(counted.sparkSession)
    return _found(scratch, scratch.save(counted.select("word", F.col("n").cast("long").alias("n")), "words"), pairs=True)


def grouped(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``counted(word, n)``, one row a different word."""
    scratch = Scratch(counted.sparkSession)
    counted = scratch.save(counted.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = _found(scratch, counted, pairs=False).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    formed = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    rows = scratch.save(
        counted.join(near, "word", "left").select(
            "word",
            F.when(formed, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    ups = rows.where("form is not null").select("word", F.col("form").alias("up"))
    while True:
        above = ups.select(F.col("word").alias("up"), F.col("up").alias("top"))
        farther = scratch.save(ups.join(above, "up", "left").select("word", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "ups")
        ups = farther.select("word", "up")
        if farther.where("moved").isEmpty():
            break
    return rows.join(ups, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, drop_every: int = DROP_EVERY, ratio: int = RATIO) -> DataFrame:
    """``grouped`` over the words of ``docs(doc_id, text)``; every ``drop_every``-th run, by its seed, has lost a character (0: none)."""
    scratch = Scratch(docs.sparkSession)
    with batches_of(docs.sparkSession, TEXT_ROWS):
        counted = scratch.save(words(docs, letters, least, drop_every), "counted")
    return grouped(counted, ratio)


def oracle(letters: int = LETTERS, least: int = LEAST, drop_every: int = DROP_EVERY, ratio: int = RATIO) -> str:
    """DuckDB SQL of ``variants``; the checksum is computed bit by bit for a table of 256 and byte by byte from there."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive crc_table as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
runs as (
  select doc, run, count(*) as n from (
    select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run0 from documents),
    lateral (select translate(run0, '{upper}', '{lower}') as run) group by doc, run),
hexed as (select *, hex(encode(doc || ':' || run)) as h from runs),
summed as (
  select run, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from hexed, crc_table),
spelled as (select case when h % {drop_every} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from summed),
words as (select word, sum(n)::bigint as n from spelled where length(word) >= {letters} group by word having sum(n) >= {least}),
gaps as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from words)),
pairs as (
  select a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by word),
formed as (
  select w.word, case when near_n >= {ratio} * n then near end as form, n, coalesce(n_near, 0) as n_near, case when near_n >= {ratio} * n then near_n end as form_n
  from words w left join best using (word)),
climb as (select word, word as at from formed union all select c.word, f.form from climb c join formed f on f.word = c.at where f.form is not null)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n from formed f
join climb c on c.word = f.word join formed top on top.word = c.at and top.form is null
"""
