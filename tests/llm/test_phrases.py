"""Phrase collocations against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import phrases


def plain(rows, max_n, least, share, top):
    counts = {}
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            for i in range(len(w)):
                for k in range(1, min(max_n, len(w) - i) + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        found = []
        for g, a in c.items():
            if len(g) < 2 or a < least:
                continue
            inside = [h for h, v in c.items() if v >= least and len(h) > len(g) and 100 * v >= share * a and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not inside:
                score, _, left, right = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(t, lang, i, "x") for i, (t, lang) in enumerate(rows)], "text string, lang string, n long, phrase string")
    return sorted(tuple(r) for r in phrases.collocations(df.repartition(3), **more).collect())


def story(r, words, n):
    return "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; "]) for _ in range(n))


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_phrases_match_a_plain_count(spark, max_n):
    r = random.Random(max_n)
    words = ["the", "The", "a", "Ä", "ä", "of", "x\x01", "x", "\x02", "x\x00y", "größe", "q" * 100, "n'y"]
    rows = [(story(r, words, r.randrange(60)), r.choice(["en", "en", "en", "de", None, "und"])) for _ in range(60)]
    kw = {"max_n": max_n, "least": 4, "share": 50, "top": 25}
    got = mined(spark, rows, **kw)
    assert got == plain(rows, **kw)
    assert {g[0] for g in got} == {"en", "de", "und"}


def all_counts(rows, max_n, hot, buckets, least=1):
    """What the tasks of both sides of the shuffle make of the rows, and the runs between them."""
    names = ["lang", "text"]
    batches = [pa.RecordBatch.from_pylist([{"lang": lang, "text": t} for t, lang in rows[at : at + 7]], pa.schema([("lang", pa.string()), ("text", pa.binary())])) for at in range(0, len(rows), 7)]
    assert all(b.schema.names == names for b in batches)
    runs = [x for b in phrases._runs(max_n, hot, buckets)(iter(batches)) for x in b.to_pylist()]
    runs.sort(key=lambda x: (x["bucket"], x["lang"]))
    table = pa.RecordBatch.from_pylist(runs, pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("codes", pa.binary()), ("n", pa.binary())]))
    found = Counter()
    parts = Counter()
    for b in phrases._counts(max_n, least, hot)(iter([table.slice(0, 3), table.slice(3)])):
        for x in b.to_pylist():
            found[x["lang"], x["phrase"]] += x["n"]
            parts[x["lang"], x["phrase"]] += 1
    return found, parts, runs


@pytest.mark.parametrize("max_n", [1, 2, 3, 4])
def test_parts_of_texts_runs_and_hot_prefixes_lose_nothing(monkeypatch, max_n):
    monkeypatch.setattr(phrases, "TEXT", 60)
    r = random.Random(max_n)
    words = [b"a", b"b", b"hot", b"pair", "ä".encode(), b"long" * 9]
    rows = [(b" ".join(r.choice(words) + r.choice([b"", b"", b".", b"\n"]) for _ in range(r.randrange(80))), r.choice(["x", "y"])) for _ in range(40)]
    want = Counter()
    for text, lang in rows:
        for piece in re.split(rb"[.\n]", text):
            w = piece.split()
            want[lang, b""] += len(w)
            for k in range(1, max_n + 1):
                want.update((lang, b" ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    want = +want
    hot = {"x": {(b"hot",), (b"hot", b"pair"), (b"hot", b"a"), (b"absent",)}, "y": {(b"a",)}}
    for h in ({}, hot):
        h = {lang: {p for p in ps if len(p) < max_n} for lang, ps in h.items()}
        found, parts, runs = all_counts(rows, max_n, h, 16)
        assert found == want and len(runs) > 40
        cut = {key for key, n in parts.items() if n > 1 and key[1]}
        assert all(tuple(p.split()) in h.get(lang, set()) for lang, p in cut)  # only hot prefixes are counted in several buckets
        assert max_n < 3 or not h or {("x", b"hot"), ("x", b"hot pair"), ("y", b"a")} <= cut
        # rare phrases are left out, but hot ones are passed on
        few, _, _ = all_counts(rows, max_n, h, 16, least=60)
        assert {k: n for k, n in few.items() if n >= 60 or not k[1]} == {k: n for k, n in want.items() if n >= 60 or not k[1]}
        assert max_n == 1 or len(few) < len(want)


def test_a_hot_first_word_and_pair(spark):
    r = random.Random(3)
    rows = [(" ".join(f"hot pair w{r.randrange(300)}" for _ in range(40)), "en") for _ in range(60)] + [("a b c d. " * 20, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    texts = df.select("lang", F.col("text").cast("binary").alias("text"))
    assert phrases.hot_prefixes(texts, 3, 0.1) == {"en": {(b"hot",), (b"hot", b"pair"), (b"pair",)}}
    counts = phrases.phrase_counts(df, 3, 2)
    got = {(x.lang, x.phrase): x.f for x in counts.collect()}
    assert got["en", ""] == 60 * 40 * 3 and got["en", "hot"] == got["en", "hot pair"] == 2400 and got["fr", "b c d"] == 20
    kw = {"max_n": 3, "least": 2, "share": 50, "top": 100}
    assert mined(spark, rows, **kw) == plain(rows, **kw)


def test_ranks_replace_numbers_that_grow_too_large():
    r = np.random.default_rng(1)
    columns = [r.integers(0, 1 << 20, 3000) for _ in range(6)]
    columns = [np.concatenate((c, c[:100])) for c in columns]
    code = phrases.combined(columns, 1 << 20)
    rows = list(zip(*columns, strict=True))
    assert np.argsort(code, kind="stable").tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], i))
    assert len(np.unique(code)) == len(set(rows))


def test_edge_cases(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, "en"), ("", "en"), (" .,\t\n", None), ("word", "de")]) == []
    rows = [("A b.", None), ("a B", "und")] * 5
    assert mined(spark, rows) == [("und", 1, "a b", 10, 10, 10, 20, 10**6)]
    assert mined(spark, [("a b c d", "en")] * 10) == [("en", 1, "a b c", 10, 10, 10, 40, 10**6), ("en", 2, "b c d", 10, 10, 10, 40, 10**6)]
    long = "x" * (3 << 20)
    assert mined(spark, [(f"{long} y " * 2 + "y", "en")], least=1, max_n=2)[0][:4] == ("en", 1, f"{long} y", 2)


def test_large_counts_are_exact(spark, monkeypatch):
    """Products beyond 64 bits."""
    grams = [("en", "", 0, 4 * 10**15), ("en", "a", 1, 999_999_999_999_937), ("en", "b", 1, 999_999_999_999_989), ("en", "a b", 2, 999_999_999_999_883)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda docs, max_n, least: spark.createDataFrame(grams, "lang string, phrase string, size int, f long"))
    a, left, right = grams[3][3], grams[1][3], grams[2][3]
    assert mined(spark, []) == [("en", 1, "a b", a, left, right, grams[0][3], 10**6 * a * a // (left * right))]
