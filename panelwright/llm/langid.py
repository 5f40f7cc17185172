"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams, most frequent first. A document's own
profile is compared with each language's by the out-of-place distance: for each of the document's
n-grams the difference of the two ranks, or the profile length where the language lacks it.

n-grams have 1 to 3 characters of the lower-cased text. Everything that is not a letter is a word
boundary; boundaries are part of 2- and 3-grams, which never span two words.

Edge cases: a null or empty text, or one without letters, gets ``und`` and score 0; so does every
document if there is nothing to learn from. Equal counts are ranked by the n-gram's code and equal
distances by the language's name. Repeated rows are counted and answered as often as they occur. A
null ``doc_id`` is held out. Columns other than doc_id, text and lang are ignored.
More languages than LANGUAGES are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: n-grams in a profile.
PROFILE = 400
ORDERS = 3
#: Languages that a model may tell apart, more than there are; the profiles sent to executors have at most LANGUAGES * PROFILE entries of 16 bytes.
LANGUAGES = 20_000
#: Characters whose n-grams are counted at once.
CHUNK = 1 << 18
_BITS = np.int64(21)
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def symbols(text: str) -> np.ndarray:
    """Letters as code point + 1; each run of other characters, and both ends, as one boundary (1)."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[cp]
    s = np.ones(len(cp) + 2, np.int64)
    s[1:-1] = np.where(letter, cp.astype(np.int64) + 1, 1)
    keep = s > 1
    keep[1:] |= s[:-1] > 1
    keep[0] = True
    return s[keep]


def grams(s: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams: 21 bits a character, absent leading characters 0."""
    inside = s > 1
    two = (s[:-1] << _BITS) | s[1:]
    three = (two[:-1] << _BITS) | s[2:]
    return np.concatenate((s[inside], two[inside[:-1] | inside[1:]], three[inside[1:-1]]))


def _pieces(s: np.ndarray):
    """Long symbol sequences in pieces that end at a boundary, so that counting needs bounded memory."""
    at = 0
    while len(s) - at > CHUNK:
        size = CHUNK
        while not len(cut := np.flatnonzero(s[at + 1 : at + size] == 1)) and at + size < len(s):
            size *= 2  # a word longer than a piece stays whole
        end = at + 1 + int(cut[-1])
        yield s[at : end + 1]
        at = end
    if len(s) - at > 1 or at == 0:
        yield s[at:]


def _sum_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    u, inv = np.unique(c, return_inverse=True)
    return u, np.bincount(inv, n, len(u)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(grams(p), return_counts=True) for p in _pieces(symbols(text))]
    return found[0] if len(found) == 1 else _sum_counts(*map(list, zip(*found, strict=True)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equal counts by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        at = np.flatnonzero(counts >= least)
        codes, counts = codes[at], counts[at]
    return codes[np.argsort(-counts, kind="stable")][:size]  # codes come sorted


def _count_partition(batches):
    """Per partition: sums of each language's n-gram counts. The tables held are those of distinct n-grams only."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        for lang, texts in pdf.groupby("lang", sort=False)["text"]:
            codes, counts, run, size = [], [], [], 0

            def flush():
                if run:
                    for piece in _pieces(np.concatenate(run)):
                        u, n = np.unique(grams(piece), return_counts=True)
                        codes.append(u)
                        counts.append(n)

            for t in texts:
                s = symbols(t)
                run.append(s if not run else s[1:])  # one boundary between two texts
                size += len(s)
                if size >= CHUNK:
                    flush()
                    run, size = [], 0
            flush()
            if lang in held:
                codes.append(held[lang][0])
                counts.append(held[lang][1])
            if codes:
                held[lang] = _sum_counts(codes, counts)
    for lang, (u, n) in held.items():
        yield pd.DataFrame({"lang": lang, "gram": u, "n": n})


@dataclass(frozen=True)
class Profiles:
    """The n-grams of all profiles: n-gram k has rank ``ranks[i]`` in language ``owners[i]`` for i in starts[k]:starts[k + 1]."""

    langs: tuple[str, ...]
    codes: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance / largest possible distance)."""
        if not text or not self.langs:
            return "und", 0.0
        codes, counts = gram_counts(text)
        if not len(codes):
            return "und", 0.0
        own = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == own)
        first, n = self.starts[at[place]], self.starts[at[place] + 1] - self.starts[at[place]]
        entry = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        # an n-gram that a language lacks counts the profile's length, one that it has the difference of ranks
        nearer = self.size - np.abs(self.ranks[entry] - np.repeat(place, n))
        away = self.size * len(own) - np.bincount(self.owners[entry], nearer, len(self.langs))
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.size * len(own))


def fit(train: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of all texts with a language in ``train(text, lang)``."""
    rows = train.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    counts = rows.mapInPandas(_count_partition, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found = top.select("lang", "gram", "rank").limit(LANGUAGES * size + 1).toPandas()
    langs, owners = np.unique(found["lang"].to_numpy(str), return_inverse=True) if len(found) else (np.zeros(0, str), np.zeros(0, np.int64))
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    grams = found["gram"].to_numpy(np.int64)
    by_gram = np.argsort(grams, kind="stable")
    codes, starts = np.unique(grams[by_gram], return_index=True)
    if not len(codes):
        codes = np.array([-1], np.int64)
        starts = np.zeros(1, np.int64)
    return Profiles(tuple(langs.tolist()), codes, np.append(starts, len(grams)), owners[by_gram].astype(np.int32), found["rank"].to_numpy(np.int32)[by_gram] - 1, size)


def predict(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score``; kept columns of these names give way to them."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    names = [f"k{i}" for i in range(len(keep))]
    # a kept text travels once
    read = names[keep.index("text")] if "text" in keep and dict(docs.dtypes)["text"] == "string" else "text"

    def run(batches):
        p = shared.value
        for pdf in batches:
            out = pdf[names].copy()
            answers = [p.predict(t) for t in pdf[read]]
            out["lang_pred"] = [a[0] for a in answers]
            out["score"] = [a[1] for a in answers]
            yield out

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *([F.col("text").cast("string").alias("text")] if read == "text" else []))
    types = dict(rows.dtypes)
    found = rows.mapInPandas(run, ", ".join([f"{n} {types[n]}" for n in names] + ["lang_pred string", "score double"]))
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "lang_pred", "score")


def held_out(doc_id="doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text, modulo 5, is 0 (also for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learns from those not held out."""
    profiles = fit(docs.where(~held_out()), size)
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
