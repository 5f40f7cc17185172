"""Phrase collocations by Suffix-sigma.

Every word occurrence gives one suffix of its piece, cut to ``max_n`` words. A task counts the equal suffixes of
some TEXT bytes and deals them by language and first word to buckets, as sorted runs: one row of bytes holds a
bucket's suffixes, as places in a list of their words. A bucket's runs are merged and sorted in reverse order, so
that what extends a phrase comes before the phrase itself, and one stack of open prefixes counts all phrases of
1 to ``max_n`` words: an entry of depth d is pushed where the first d words change and popped, with all that
was counted above it, where they change next. The stack is taken depth by depth over whole columns of numbers.
Its bottom, the prefix without words, counts a language's words.

A prefix that holds more than a quarter of a bucket's share of all suffixes is hot; its suffixes are dealt by
one word more, so a frequent word, or pair of words, fills as many buckets as it needs. Only hot prefixes
have counts in several buckets: these are passed on whatever they are, and summed. All others are complete,
and the rare ones are left out at once. Which prefixes are hot is read from a sample of at most SAMPLE
documents' first HINT characters; it decides where suffixes go, never what is counted.
A bucket is for about BUCKET bytes of text; their number grows with the table.

Parts are joined afterwards: of each candidate and each of its cuts the counts of both sides, by two joins
of the frequent phrases with themselves; a part is at least as frequent as its candidate. Scores are integers
of up to 38 digits, exact for counts up to 10**15. Drops need one maximum per contained phrase. The best of a
language are found in SLICES slices of its candidates first.

Edge cases: a null text has no words; a null language is ``und``, together with the documents that say so; a
language without candidates has no rows; repeated rows count as often as they occur; other columns are ignored.
Texts are bytes of UTF-8 here; those of more than TEXT bytes are counted in parts that overlap by ``max_n`` - 1 words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.base import Scratch, batches_of, join_measured, mix64

MAX_N, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Bytes of text whose suffixes are counted at once and that a bucket is for; the sample that tells hot prefixes.
TEXT, BUCKET, SAMPLE, HINT = 4 << 20, 16 << 20, 2048, 16_384
#: Rows, of texts and of runs, in an Arrow batch.
ROWS = 160
#: Slices of a language's candidates that are ranked before the language is.
SLICES = 16
_TO = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 32]] = True
_GAP = re.compile(rb"[ \t\n]")
RUNS = "bucket int, lang string, words binary, codes binary, n binary"


def segments(text: bytes, max_n: int):
    """(bytes, number of bytes in which suffixes start) of a translated text; parts end between words and overlap."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + TEXT) if at + TEXT < len(text) else None
        end = gap.start() if gap else len(text)
        more = re.compile(rb"(?:[ \t]+[^ \t\n]+){0,%d}" % (max_n - 1)).match(text, end)
        yield text[at : more.end()], end - at
        at = end


def combined(columns: list[np.ndarray], base: int) -> np.ndarray:
    """One number for each row of columns with values below ``base``, in the rows' order; dense ranks replace numbers that would grow too large."""
    code, size = columns[0].astype(np.int64), base
    for c in columns[1:]:
        if size * base >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
        code = code * base + c
        size *= base
    return code


def sorted_vocabulary(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the different words in order, each word's place among them, from 1)."""
    coded = pc.dictionary_encode(words)
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def suffixes(parts: list[tuple[bytes, int]], max_n: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """(words in order, columns of places among them, from 1, or 0 for none, counts) of the different suffixes, sorted."""
    a = np.frombuffer(b"\n".join(p for p, _ in parts), np.uint8)
    blank = _BLANK[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words, ids = sorted_vocabulary(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(a[~blank])]))
    piece = np.cumsum(a == 10)[start]
    columns = [ids]
    for k in range(1, max_n):
        c = np.zeros(len(ids), np.int64)
        c[:-k] = np.where(piece[k:] == piece[:-k], ids[k:], 0)
        columns.append(c)
    if any(own < len(p) for p, own in parts):
        starts = np.cumsum([0] + [len(p) + 1 for p, _ in parts[:-1]])
        own = np.searchsorted(starts, start, side="right") - 1
        mine = start - starts[own] < np.array([o for _, o in parts])[own]
        columns = [c[mine] for c in columns]
    _, first, counts = np.unique(combined(columns, len(words) + 1), return_index=True, return_counts=True)
    return words, [c[first] for c in columns], counts


def places(lang: str, words: pa.Array, columns: list[np.ndarray], hot: set[tuple[bytes, ...]], buckets: int) -> np.ndarray:
    """The bucket of each suffix: by language and first word, and by one word more for as long as the prefix is hot."""
    own = np.array([0, *(zlib.crc32(w) + 1 for w in words.to_pylist())], np.uint64)
    place = {w: i + 1 for i, w in enumerate(words.to_pylist())} if hot else {}
    mark = mix64(own[columns[0]] + np.uint64(zlib.crc32(lang.encode()) << 32))
    open_, prefix = np.ones(len(columns[0]), bool), np.zeros(len(columns[0]), np.int64)
    for depth in range(1, len(columns)):
        tails = [h for h in hot if len(h) == depth and all(w in place for w in h)]
        rows = np.flatnonzero(open_)
        values = combined([c[rows] for c in columns[:depth]], len(words) + 1) if depth < 3 else None
        if values is None:  # deeper prefixes are compared word by word
            found = np.zeros(len(rows), bool)
            for h in tails:
                found |= np.all([columns[k][rows] == place[w] for k, w in enumerate(h)], axis=0)
        else:
            found = np.isin(values, [combined([np.array([place[w]]) for w in h], len(words) + 1)[0] for h in tails])
        prefix[rows] = found
        open_ = np.zeros(len(open_), bool)
        open_[rows[found]] = True
        if not found.any():
            break
        mark = np.where(open_, mix64(mark + own[columns[depth]]), mark)
    return (mark % np.uint64(buckets)).astype(np.int64)


def _runs(max_n: int, hot: dict[str, set], buckets: int):
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                words, columns, counts = suffixes(parts, max_n)
                if not len(counts):
                    continue
                to = places(lang, words, columns, hot.get(lang, set()), buckets)
                order = np.argsort(to, kind="stable")
                cuts = np.concatenate((np.flatnonzero(np.diff(to[order], prepend=-1)), [len(order)]))
                out = {c: [] for c in ("bucket", "words", "codes", "n")}
                for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                    rows = order[at:end]
                    own = np.stack([c[rows] for c in columns])
                    used = np.unique(own)
                    used = used[used > 0]
                    codes = np.where(own > 0, np.searchsorted(used, own) + 1, 0)
                    out["bucket"].append(int(to[rows[0]]))
                    out["words"].append(b"\t".join(words.take(pa.array(used - 1)).to_pylist()))
                    out["codes"].append(codes.astype(np.uint16 if len(used) < 65_535 else np.uint32).tobytes())
                    out["n"].append(counts[rows].astype(np.uint32).tobytes())
                types = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                data = (out["bucket"], [lang] * len(out["n"]), out["words"], out["codes"], out["n"])
                yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, types, strict=True)], names=["bucket", "lang", "words", "codes", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (text := text.as_py()) is None:
                    continue
                for part in segments(text.translate(_TO), max_n):
                    held.setdefault(lang, []).append(part)
                    size += len(part[0]) + 1
                    if size >= TEXT:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def merged(runs: list[tuple[bytes, bytes, bytes]], max_n: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """The suffixes of several runs like those of one, in reverse order, equal ones next to each other."""
    lists = [w.split(b"\t") for w, _, _ in runs]
    words, ids = sorted_vocabulary(pa.array([w for one in lists for w in one], pa.binary()))
    columns, counts, at = [[] for _ in range(max_n)], [], 0
    for one, (_, codes, n) in zip(lists, runs, strict=True):
        to = np.concatenate(([0], ids[at : at + len(one)]))
        at += len(one)
        for c, mine in zip(columns, np.frombuffer(codes, np.uint16 if len(one) < 65_535 else np.uint32).reshape(max_n, -1), strict=True):
            c.append(to[mine])
        counts.append(np.frombuffer(n, np.uint32).astype(np.int64))
    columns, counts = [np.concatenate(c) for c in columns], np.concatenate(counts)
    order = np.argsort(combined(columns, len(words) + 1))[::-1]
    return words, [c[order] for c in columns], counts[order]


def popped(words: pa.Array, columns: list[np.ndarray], counts: np.ndarray, least: int, hot: set[tuple[bytes, ...]]):
    """(phrases, size, counts) that the stack hands out of sorted suffixes, depth by depth: the frequent ones, and the hot whatever their count."""
    changed = np.zeros(len(counts), bool)
    changed[0] = True
    for depth, c in enumerate(columns, 1):
        changed[1:] |= c[1:] != c[:-1]
        pushed = np.flatnonzero(changed)
        sums = np.add.reduceat(counts, pushed)
        whole = c[pushed] > 0
        tails = [h for h in hot if len(h) == depth]
        keep = whole & (sums >= least)
        rest = np.flatnonzero(whole & ~keep) if tails else []
        rows = pushed[keep]
        phrases = pc.binary_join_element_wise(*[words.take(pa.array(x[rows] - 1)) for x in columns[:depth]], b" ") if depth > 1 else words.take(pa.array(c[rows] - 1))
        yield phrases, depth, sums[keep]
        if len(rest):
            names = [tuple(words[int(x[pushed[r]]) - 1].as_py() for x in columns[:depth]) for r in rest] if len(rest) < 1000 else _named(words, columns[:depth], pushed[rest], tails)
            found = [(b" ".join(w), int(sums[r])) for w, r in zip(names, rest, strict=True) if w in hot]
            if found:
                yield pa.array([f[0] for f in found], pa.binary()), depth, np.array([f[1] for f in found])


def _named(words: pa.Array, columns: list[np.ndarray], rows: np.ndarray, tails: list[tuple[bytes, ...]]) -> list[tuple]:
    """The words of rows that may be hot; () for the others, told by their first word."""
    firsts = np.isin(columns[0][rows], pc.index_in(pa.array([h[0] for h in tails], pa.binary()), value_set=words).drop_null().to_numpy() + 1)
    return [tuple(words[int(x[r]) - 1].as_py() for x in columns) if f else () for r, f in zip(rows, firsts, strict=True)]


def _counts(max_n: int, least: int, hot: dict[str, set]):
    names = ["lang", "phrase", "size", "n"]

    def counted(lang, runs):
        words, columns, counts = merged(runs, max_n)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b""], pa.binary()), pa.array([0], pa.int32()), pa.array([int(counts.sum())])], names=names)
        for phrases, size, n in popped(words, columns, counts, least, hot.get(lang, set())):
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases, pa.array(np.full(len(n), size, np.int32)), pa.array(n, pa.int64())], names=names)

    def run(batches):
        current, held = None, []
        for batch in batches:
            for bucket, lang, *data in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                if (bucket, lang) != current:
                    if held:
                        yield from counted(current[1], held)
                    current, held = (bucket, lang), []
                held.append(tuple(data))
        if held:
            yield from counted(current[1], held)

    return run


def hot_prefixes(texts: DataFrame, max_n: int, share: float) -> dict[str, set[tuple[bytes, ...]]]:
    """By language the prefixes of fewer than ``max_n`` words with more than ``share`` of all suffixes of a sample, closed under prefixes."""
    rows = texts.count()
    some = texts.select("lang", F.substring("text", 1, HINT).alias("text"))
    if rows > SAMPLE:
        some = some.sample(SAMPLE / rows, 11)
    by: dict[str, list] = {}
    for r in some.limit(SAMPLE).toLocalIterator():
        by.setdefault(r.lang, []).append((bytes(r.text or b"").translate(_TO), HINT))
    counts: Counter = Counter()
    total = 0
    for lang, parts in by.items():
        words, columns, n = suffixes(parts, max_n)
        for depth in range(1, max_n):
            rows = np.flatnonzero(columns[depth - 1])
            if not len(rows):
                break
            _, first, at = np.unique(combined([c[rows] for c in columns[:depth]], len(words) + 1), return_index=True, return_inverse=True)
            sums = np.bincount(at, n[rows]).astype(np.int64)
            # what can't be hot in all of the sample isn't hot in a part of it
            for i in np.flatnonzero(sums > share * n.sum()):
                counts[lang, tuple(words[int(c[rows[first[i]]]) - 1].as_py() for c in columns[:depth])] = int(sums[i])
        total += int(n.sum())
    hot: dict[str, set] = {}
    for (lang, prefix), n in counts.items():
        if n > share * total:
            hot.setdefault(lang, set()).add(prefix)
    return hot


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, f): phrases of up to ``max_n`` words that occur ``least`` times, words joined by a space; the one of size 0 counts all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-size // BUCKET))
    hot = hot_prefixes(texts, max_n, 0.25 / buckets)
    runs = texts.mapInArrow(_runs(max_n, hot, buckets), RUNS)
    dealt = runs.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "lang")
    found = dealt.mapInArrow(_counts(max_n, least, hot), "lang string, phrase binary, size int, n long")
    sums = found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size").agg(F.sum("n").alias("f"))
    return sums.where((F.col("f") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs(text, lang)``: each language's ``top`` phrases of 2 to ``max_n`` words."""
    scratch = Scratch(docs.sparkSession)
    with batches_of(docs.sparkSession, ROWS):
        grams = scratch.save(phrase_counts(docs, max_n, least), "phrases")
    candidates = grams.where("size >= 2").withColumnRenamed("f", "a")
    part = lambda name, side: grams.where("size >= 1").select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    cuts = cuts.join(part("l", "left"), ["lang", "left"]).join(part("r", "right"), ["lang", "right"])
    score = F.expr("cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: F.array_join(F.slice(words, at, m), " "))))
    longer = candidates.where("size >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    by = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    slices = kept.withColumn("__slice", F.pmod(F.hash("phrase"), F.lit(SLICES)))
    best = slices.withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__slice").orderBy(*by))).where(F.col("__at") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    totals = grams.where("size = 0").select("lang", F.col("f").alias("n"))
    return join_measured(best, totals, "lang", "inner", totals.count()).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """DuckDB SQL of ``collocations`` for phrases of 2 to 3 words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
worded as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, k as size, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from worded) s, (values (1), (2), (3)) sizes(k) where i + k - 1 <= len(w)),
counts as (select lang, size, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from counts where size = 1 group by lang),
c as (select lang, size, phrase, string_split(phrase, ' ') as w, f as a from counts where size >= 2 and f >= {least}),
cuts as (
  select c.lang, c.size, c.phrase, c.a, k, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
  from (select *, unnest(range(1, size)) as k from c) c
  join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : k], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1 :], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, phrase, max(a) as longer from (
    select lang, array_to_string(w[1 : 2], ' ') as phrase, a from c where size = 3
    union all select lang, array_to_string(w[2 : 3], ' '), a from c where size = 3) group by all),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
  from lowest left join longer using (lang, phrase) join totals using (lang)
  where longer is null or not 100 * longer >= {share} * a)
select * from ranked where rank <= {top}
"""
