"""Automata and spelling variants against comparing all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from panelwright.llm import spelling
from panelwright.llm.automaton import Automaton


def near(x, y):
    """Exactly one character inserted, deleted or replaced."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, ratio=2):
    form = {}
    rows = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = (n, len(others), counts[best] if form[w] else None)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), *rows[w]) for w in counts)


def table(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def some_words(r, n, letters="abcà", sizes=(1, 9)):
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(*sizes))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(3))
def test_automaton_numbers_and_completes(seed):
    r = random.Random(seed)
    words = some_words(r, 900)
    a = Automaton(words)
    assert len(a) == len(words) and [a.number(w) for w in words] == list(range(len(words)))
    assert len(a.edges) < len("".join(words)) / 3  # suffixes are shared
    assert all(a.number(w) is None for w in some_words(r, 300, "abcd") if w not in words)
    for w in r.sample(words, 60) + some_words(r, 60, "abcd") + [""]:
        for half in (0, len(w) // 2, len(w)):
            want = {v for v in words if v.startswith(w[:half]) and near(w[half:], v[half:])}
            assert {words[i] for i in a.with_one_error(w[:half], w[half:])} == want


def test_automaton_is_minimal():
    words = some_words(random.Random(8), 400)
    tails = {p: frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(Automaton(words).edges) == len(set(tails.values()))
    assert len(Automaton([])) == 0 and Automaton([]).with_one_error("", "a") == set() and len(Automaton([""])) == 1


def test_variants_match_comparing_all_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD", 40)  # a prefix reaches over several ranges
    r = random.Random(4)
    counts = {w: r.choice([3, 3, 4, 6, 8, 12, 24, 50, 100]) for w in [*some_words(r, 700, "abà", (5, 8)), *some_words(r, 200, "xyzéß", (5, 12))]}
    counts |= {"aaaaa" + w: 3 for w in some_words(r, 150, "ab", (3, 8))}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = table(spelling.grouped(df))
    assert got == plain(counts)
    pairs = [(x.word, x.near, x.near_n) for x in spelling.near_pairs(df).collect()]
    assert sorted(pairs) == sorted((a, b, counts[b]) for a in counts for b in counts if near(a, b))  # each once
    assert max(sum(w == a for a, _, _ in pairs) for w in counts) > 8 and any(g[1] and g[2] != g[1] for g in got)


def test_documents_match_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CHARACTERS", 30)
    monkeypatch.setattr(spelling, "COUNTED", 20)
    r = random.Random(6)
    pool = ["Straße", "strasse", "STRASSE", "École", "école", "naïve", "naive", "colour", "color", "colours", "abcde", "abcdÀ", "abcdà", "a×b÷c", "Ωmega", "long" * 30]
    docs = [(i, " ".join(r.choice(pool) + r.choice(["", ",", "1x", "-ing", "́"]) for _ in range(80))) for i in range(70)]
    docs += [(None, "color colors colour"), (3, None), (4, ""), (5, "12 3"), *docs[:5]]
    for drop in (3, 97, 0):
        counts = Counter()
        for doc, text in docs:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
                if drop and h % drop == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                counts[w] += 1
        counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
        df = spark.createDataFrame([(t, "x", i, 1) for i, t in docs], "text string, word string, doc_id long, n int").repartition(4)
        assert table(spelling.variants(df, drop_every=drop)) == plain(counts)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert table(spelling.variants(empty)) == []
    assert table(spelling.variants(spark.createDataFrame([(1, None), (2, ""), (None, "one two")], "doc_id long, text string"))) == []
    ties = {"aaaaa": 10, "aaaab": 10, "aaaac": 5, "aaaad": 6, "bbbbb": 1}
    got = table(spelling.grouped(spark.createDataFrame(list(ties.items()), "word string, n long")))
    assert got == [("aaaaa", None, "aaaaa", 10, 3, None), ("aaaab", None, "aaaab", 10, 3, None), ("aaaac", "aaaaa", "aaaaa", 5, 3, 10), ("aaaad", None, "aaaad", 6, 3, None), ("bbbbb", None, "bbbbb", 1, 0, None)]
    chain = {"aaaaaaaaaaaa"[:i] + "bbbbbbbbbbbb"[i:]: 2**i for i in range(13)}
    got = table(spelling.grouped(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {g[2] for g in got} == {"a" * 12} and got == plain(chain)
