"""MinHash and embedding near-dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from panelwright.llm import minhash, multiindex
from panelwright.llm.base import Scratch, batch_word_hashes, components, word_hashes


def brute(rows):
    """(set size, smallest id reachable) by id."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i in sorted(sets):
        n = defaultdict(int)
        for g in sets[i]:
            for j in by[g]:
                n[j] += 1
            by[g].append(i)
        for j, c in n.items():
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_duplicates_match_brute_force_on_documents(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = brute([(r["doc_id"], r["text"]) for r in rows])
    assert found(minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))) == want


def test_dense_group_of_near_copies_and_chain(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):  # copies with one to nine words changed: similarities on both sides of 0.75
        w = list(base)
        for _ in range(r.randrange(1, 10)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = list(base)
    for i in range(200, 230):  # each a neighbour of the one before only
        chain = chain[4:] + [f"y{i}_{k}" for k in range(4)]
        rows.append((i, " ".join(chain)))
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows)
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_edge_cases_of_documents(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \t ", 7), (4, "a b", 7), (5, "A  b", 7), (6, "b a", 7), (7, "one two three four five", 7), (7, "one two three four five", 7), (None, "one two three four five", 7)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (None, 1, None, True)}
    assert len(out) == len(rows)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_of_a_bucket_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SLOT", 4)
    test_dense_group_of_near_copies_and_chain(spark)


def test_a_stranger_in_a_bucket_of_copies(spark, monkeypatch):
    """Large components stand on one side of a bucket; the others are compared with them and each other."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(9)
    base = [f"w{r.randrange(9000)}" for _ in range(150)]
    rows = []
    for i in range(150):  # near copies of one text
        w = list(base)
        w[r.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(40):  # on both sides of the threshold to them
        w = list(base)
        for k in range(0, r.randrange(20, 32) * 4, 4):
            w[k] = f"s{i}_{k // 40}"
        rows.append((500 + i, " ".join(w)))
    far = base[:70] + [f"z{k}" for k in range(60)]
    rows += [(700 + i, " ".join(far[i:])) for i in range(25)]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_unusual_texts(spark):
    """Equal sets of other sequences, words built to collide under polynomial hashes, very long texts."""
    loop = "a b c d e f g h".split()
    rows = [(3, " ".join(loop * 3)), (1, " ".join((loop * 5)[3:])), (2, " ".join(loop * 3) + " "), (9, "A B c d e f g h a b c d e f g h a b c d e f g h"), (7, " ".join(reversed(loop * 3)))]
    word = "a"  # a Thue-Morse word and its complement are equal under any odd base modulo 2**64
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    rows += [(11, word), (12, word.translate({97: 98, 98: 97})), (13, word.upper()), (14, "x " + word)]
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(100_000)]
    rows += [(21, " ".join(words)), (22, " ".join(words[:80_000])), (23, " ".join(words[:65_000])), (24, " ".join(words[:1000]))]
    got = found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 11: 11, 12: 12, 13: 11, 14: 14, 21: 21, 22: 21, 23: 21, 24: 24}


def test_estimate_is_close_to_the_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 1000, np.uint64)
    for common in (900, 750, 400):
        a, b = np.unique(x[:common].tolist() + r.integers(0, 1 << 63, 1000 - common, np.uint64).tolist()), None
        a = a.astype(np.uint64)
        b = np.sort(x)
        m = minhash.equal_fields(minhash.pack(minhash.minima(a)), minhash.pack(minhash.minima(b)))
        j = common / (2000 - common)
        assert abs((m / minhash.K - 0.25) / 0.75 - j) < 0.08


def test_word_hashes_of_long_texts_are_those_of_short_ones(monkeypatch):
    import panelwright.llm.base as base

    text = "Word ünïcode  x\ty " * 50 + "z" * 300
    whole = word_hashes(text.encode())[0].tolist()
    monkeypatch.setattr(base, "SEGMENT", 64)
    assert base.word_hashes(text.encode())[0].tolist() == whole
    h, bounds = batch_word_hashes([text, None, "", "word"])
    assert bounds.tolist() == [0, len(whole), len(whole), len(whole), len(whole) + 1] and h[-1] == whole[0]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 4)]
    want = {}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    want = {x: find(x) for x in up}
    got = components(Scratch(spark), spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.label for r in got.collect()} == want


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_vectors(rows):
    good = {}
    for i, v, lab in rows:
        if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = (x / np.sqrt((x * x).sum()), lab)
    links = {i: {j for j in good if j != i and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.93} for i in good}
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen))
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(multiindex, "BLOCK", block)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 16))
    rows = []
    for i in range(300):
        v = centres[i % 6] * 1.0 + r.normal(size=16) * r.choice([0.05, 0.2, 0.4, 2.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 4 == 0)))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)] + [(1100 + i, rows[5][1], rows[5][2]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [nan] * 16, 1), (2004, [inf] + [1.0] * 15, 1), (2005, [None] + [1.0] * 15, 1), (2006, rows[0][1], None), (2007, [1.0, 2.0], 1), (2008, [1.0, 2.0], 1), (2009, [3.0], 1), (2010, [5.0], 1), (2011, [-0.0, 1.0], 1), (2012, [0.0, 1.0], 1)]
    got = multiindex.near_vectors(vectors(spark, rows)).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in got} == brute_vectors(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_no_vectors(spark):
    assert multiindex.near_vectors(vectors(spark, [])).collect() == []
    assert multiindex.near_vectors(vectors(spark, [(1, None, None)])).collect()[0][:] == (1, 0, 1, True)


def test_traversal_visits_cells_in_order_and_misses_none():
    r = np.random.default_rng(4)
    b1, b2 = r.random((30, 12)), r.random((30, 9))
    row, i, j = multiindex.multi_sequence(b1, b2, 0.8)
    for k in range(30):
        costs = (b1[k, i[row == k]] + b2[k, j[row == k]]).tolist()
        assert costs == sorted(costs)
        assert sorted(zip(i[row == k].tolist(), j[row == k].tolist())) == [(a, b) for a in range(12) for b in range(9) if b1[k, a] + b2[k, b] <= 0.8]
    assert [len(x) for x in multiindex.multi_sequence(b1 + 1, b2, 0.8)] == [0, 0, 0]


def test_bounds_of_cells_hold():
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 8))
    own, bound = multiindex.half_bounds(x, multiindex._kmeans(x, 10))
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert (bound[:, own] <= apart + 1e-9).all() and (bound[np.arange(400), own] == 0).all() and bound.max() > 0


def test_measured_recall(spark):
    """At a target below 1 the stop is measured on the sample; recall is that of brute force over all rows."""
    r = np.random.default_rng(11)
    centres = r.normal(size=(60, 12))
    rows = [(i, [float(v) for v in centres[i % 60] + r.normal(size=12) * 0.12 * (1 + i % 3)], i % 2) for i in range(1500)]
    links = lambda got: sum(n for n, _ in got.values())
    want = brute_vectors(rows)
    for recall, least in ((0.95, 0.9), (1.0, 1.0)):
        got = {x.vec_id: (x.n_links, x.component_id) for x in multiindex.near_vectors(vectors(spark, rows), recall=recall, k=8).collect()}
        assert least <= links(got) / links(want) <= 1 and all(got[i][0] <= want[i][0] for i in want)
    assert got == want
    assert multiindex.centroids(100) == 8 and multiindex.centroids(4 * 10**6) > 5 * multiindex.centroids(10**5) and multiindex.centroids(10**12) == 256
