"""Projected neighbours against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.llm import projections
from panelwright.llm.projections import Space, Tree, chi_square, descend, quantile, recall, split, to_boxes

EVERY = 20


def truth(rows, k=20, every=EVERY):
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = []
    for q, v in good:
        if q % every == 0:
            best = sorted((-float((np.array(w) * np.array(v)).sum()), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, peak int, place string")
    return projections.nearest(df.repartition(3), F.col("vec_id") % EVERY == 0, **more).toPandas()


def clustered(n, dim=32, seed=1, spread=0.15):
    r = np.random.default_rng(seed)
    x = r.standard_normal((12, dim))[r.integers(0, 12, n)] + spread * r.standard_normal((n, dim))
    return [(int(i), v.tolist()) for i, v in zip(r.permutation(n), x * r.uniform(0.5, 2, (n, 1)), strict=True)]


def test_chi_square_distribution():
    r = np.random.default_rng(0)
    for m in (2, 6, 12):
        sample = (r.standard_normal((200_000, m)) ** 2).sum(1)
        for p in (0.1, 0.5, 0.95):
            x = quantile(p, m)
            assert abs(chi_square(x, m) - p) < 1e-9 and abs((sample <= x).mean() - p) < 0.006
    for p, m in ((0.5, 3), (0.0, 4), (1.0, 4)):
        with pytest.raises(ValueError):
            quantile(p, m)


def test_projected_distances_follow_it():
    r = np.random.default_rng(3)
    x, q = r.standard_normal((50, 64)) * r.uniform(0.1, 3, (50, 1)), r.standard_normal((1, 64))
    s, share = Space(64, np.abs(x).max(), math.log2(np.sqrt((x**2).sum(1)).max())), []
    for _ in range(400):  # the probability is one over directions
        s.directions = r.standard_normal(s.directions.shape)
        away = ((s.project(x, False) - s.project(q, True)) ** 2).sum(1)
        share.append((away <= s.reach((q[0] ** 2).sum() * s.scale**2, x @ q[0])).mean())
    assert 0.93 < np.mean(share) < 0.97


def test_tree_reads_leaves_by_their_boxes():
    r = np.random.default_rng(5)
    points = r.standard_normal((3000, 4))
    nodes = split(points, 16)
    leaf = descend(points, nodes)
    assert len(nodes) == 15 and np.bincount(leaf, minlength=16).min() > 150
    low, high = (np.array([f(points[leaf == i], axis=0) for i in range(16)]) for f in (np.min, np.max))
    boxes = to_boxes(points, low, high)
    assert (boxes[np.arange(3000), leaf] == 0).all()
    assert (boxes[:50] <= np.array([[((points[leaf == i] - p) ** 2).sum(1).min() for i in range(16)] for p in points[:50]]) + 1e-12).all()
    assert descend(points, split(points, 1)).max() == 0 and len(set(descend(np.zeros((9, 4)), split(np.zeros((9, 4)), 8)))) == 1


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = projections.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % EVERY == 0).toPandas()
    want = truth(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.9


@pytest.mark.parametrize("k", [5, 20])
def test_recall_over_many_cells_and_parts(spark, monkeypatch, k):
    monkeypatch.setattr(projections, "PART", 200)
    rows = clustered(3000)
    want = truth(rows, k)
    got = found(spark, rows, k=k, cell=150)
    assert recall(got, want) >= 0.9 and len(got) == len(want)
    exact = dict(zip(zip(want["query_id"], want["vec_id"]), want["score"]))  # noqa: B905
    assert all(exact.get((r.query_id, r.vec_id), r.score) == r.score for r in got.itertuples())
    assert (got.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").cumcount() + 1).sort_index().equals(got["rank"].astype("int64"))
    certain = found(spark, rows, k=k, cell=150, confidence=1 - 1e-9)
    keys = ["query_id", "rank"]
    assert certain.sort_values(keys)[["query_id", "rank", "vec_id", "score"]].values.tolist() == want.sort_values(keys).values.tolist()


def test_the_test_stops_early_on_structured_vectors():
    rows = clustered(12_000, dim=64)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    tree = Tree(ids, x, Space(64, np.abs(x).max(), math.log2(np.sqrt((x**2).sum(1)).max())), 20)
    q = np.flatnonzero(ids % 100 == 0)
    row, near, _ = tree.search(ids[q], x[q], np.full(len(q), -np.inf))
    got = {ids[j]: set(near[row == k]) for k, j in enumerate(q)}
    hits = 0
    for j in q:
        s = x @ x[j]
        s[j] = -np.inf
        hits += len(got[ids[j]] & set(ids[np.argsort(-s)[:20]]))
    assert hits >= 0.9 * 20 * len(q) and tree.verified < 0.3 * len(q) * len(ids)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, -1.0]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [9.0, 9.0]), (20, [1.0, 0.0, 0.0]), (11, [0.0, 3.0, 1.0]), (40, None), (60, [5.0])]
    got = sorted(tuple(r) for r in found(spark, rows).itertuples(index=False))
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, -1.0), (20, 1, 11, 0.0)]
    assert len(found(spark, [])) == 0 and len(found(spark, [(1, [1.0])])) == 0


def test_a_third_of_the_rows_is_one_vector(spark, monkeypatch):
    monkeypatch.setattr(projections, "PART", 64)
    rows = clustered(600, dim=8) + [(1000 + i, [1.0] * 8) for i in range(300)]
    got = found(spark, rows, cell=100)
    ties = got[got["query_id"] == 1020].sort_values("rank")
    same = [i for i in range(1000, 1300) if i != 1020]
    want = truth(rows)
    want = want[want["query_id"] == 1020].sort_values("rank")
    at = (want["score"] == 8.0).to_numpy()
    assert ties["vec_id"][(ties["score"] == 8.0).to_numpy()].tolist() == [i for i in want["vec_id"][at]] and set(want["vec_id"][at]) <= set(same) | {i for i, _ in rows}


def test_large_and_small_components(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((400, 6))
    for factor in (1e150, 1e-150, 1e300):
        rows = [(i, (v * factor).tolist()) for i, v in enumerate(base)]
        got = found(spark, rows, k=3)
        assert len(got) == 20 * 3
        if factor < 1e200:
            assert recall(got, truth(rows, 3)) >= 0.9
