"""Approximate nearest neighbours by low-dimensional stable projections, indexed by kd-trees.

The largest inner product becomes the smallest distance by one more component: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Vectors are projected
on DIMENSIONS Gaussian directions. As the Gaussian is 2-stable, the squared distance of two projections,
divided by that of the vectors, has the chi-square distribution with as many degrees of freedom.

A query takes projected neighbours by rising distance, a leaf of the tree at a time, and verifies them by their inner product. With d the
distance of its k-th best so far, it stops once the projected distance r passes the test

    P(chi-square <= r^2 / d^2) >= CONFIDENCE

since a vector nearer than d would have come before r with that probability over the draw of directions, so
each true neighbour is found with at least it. kd-trees give the neighbours: a leaf, or a cell, whose box lies beyond the stop isn't read.

On the cluster the upper levels of one kd-tree, fitted on at most SAMPLE rows (those with the smallest
hashes), divide all vectors into cells of about CELL vectors, up to CELLS cells; every vector is
indexed. A cell with more than PART vectors is cut into parts by a hash of their ids; a task holds the tree of one part and
streams the queries sent to it. A query first searches its nearest cell. Then it goes, with the threshold
found there, to those cells only that the test leaves open; no cell starts without a threshold. A task
returns k rows a query at most. The directory of cells has one row a cell.

Scores are sums in one fixed order, so equal vectors have equal scores, and ties go to the smaller vec_id.

Edge cases: vectors that are null, empty or zero or hold null or non-finite components, and rows with a null id,
take no part; only vectors of equal length are compared; rows with the query's vec_id are not its candidates;
rows repeated with the same id and vector count once; a query with fewer than k candidates gets them all; other
columns are ignored but for ``queries``, which may use any. Products beyond a double are infinite scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.base import Scratch
from panelwright.llm.vectors import frame, packed, runs, stacked

K = 20
#: Projected components (an even number), and the probability with which a neighbour is to be found.
DIMENSIONS, CONFIDENCE = 12, 0.95
SAMPLE, CELL, CELLS, PART, LEAF = 8192, 8192, 1024, 16_384, 64
_QUERIES = 512


def chi_square(x: float, degrees: int) -> float:
    """P(chi-square <= x) for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, degrees: int) -> float:
    """The x with chi_square(x) = p."""
    if degrees % 2 or not 0 < p < 1:
        raise ValueError(f"no quantile {p} of {degrees} degrees of freedom here: an even number and a probability are needed")
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


class Space:
    """Projection and distances of the vectors of one length; ``scale`` is a power of two, so that nothing overflows."""

    def __init__(self, dim: int, peak: float, size: float, m: int = DIMENSIONS, confidence: float = CONFIDENCE):
        self.scale = 2.0 ** -math.frexp(peak)[1]
        self.most = (2.0 ** (size + math.log2(self.scale))) ** 2  # of the squared norms, scaled
        self.directions = np.random.default_rng([dim, m]).standard_normal((dim + 1, m))
        self.stop = quantile(confidence, m)

    def project(self, x: np.ndarray, asks: bool) -> np.ndarray:
        y = x * self.scale
        last = np.zeros(len(y)) if asks else np.sqrt((self.most - (y * y).sum(axis=1)).clip(0))
        return y @ self.directions[:-1] + last[:, None] * self.directions[-1]

    def reach(self, norm: float, score):
        """Squared projected distance at which a query of this scaled squared norm stops, given its k-th best score.

        A billionth of the norms is added for rounding, so that vectors equal to the query are always reached.
        """
        whole = norm + self.most
        return self.stop * (np.maximum(whole - 2 * np.asarray(score) * self.scale * self.scale, 0) + 1e-9 * whole)


def split(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """The inner nodes of a kd-tree with that many leaves (a power of two), as (axis, value), by halving the widest axis."""
    nodes: list = []
    level = [points]
    while len(level) < leaves:
        below = []
        for part in level:
            axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else math.inf
            nodes.append((axis, value))
            left = part[:, axis] < value if len(part) else np.zeros(0, bool)
            below += [part[left], part[~left]]
        level = below
    return nodes


def descend(points: np.ndarray, nodes: list) -> np.ndarray:
    """The leaf of each point."""
    at = np.zeros(len(points), np.int64)
    axis, value = (np.array([n[i] for n in nodes]) for i in (0, 1)) if nodes else (np.zeros(0, int), np.zeros(0))
    for _ in range(int(math.log2(len(nodes) + 1))):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] >= value[at])
    return at - len(nodes)


def to_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        p = points[:, axis, None]
        out += np.maximum(np.maximum(low[None, :, axis] - p, p - high[None, :, axis]), 0) ** 2
    return out


class Tree:
    """A kd-tree over the projections of a part's vectors. ``verified`` counts the inner products taken."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, space: Space, k: int):
        self.space, self.k, self.verified = space, k, 0
        projected = space.project(x, asks=False)
        pending, leaves = [np.arange(len(ids))], []
        while pending:
            part = pending.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            axis = int(np.ptp(projected[part], axis=0).argmax())
            order = np.argpartition(projected[part, axis], len(part) // 2)
            pending += [part[order[len(part) // 2 :]], part[order[: len(part) // 2]]]
        order = np.concatenate(leaves)
        self.ids, self.x, self.projected = ids[order], x[order], projected[order]
        self.squares = (self.projected * self.projected).sum(axis=1)
        ends = np.cumsum([len(leaf) for leaf in leaves])
        self.leaves = [np.arange(e - len(leaf), e) for e, leaf in zip(ends, leaves, strict=True)]
        self.low = np.array([self.projected[i].min(axis=0) for i in self.leaves])
        self.high = np.array([self.projected[i].max(axis=0) for i in self.leaves])

    def search(self, ids: np.ndarray, q: np.ndarray, floors: np.ndarray):
        """(query row, vec_id, score) columns: up to k neighbours of each query that aren't below its floor, its k-th best score elsewhere.

        All queries walk in lockstep, each through its own leaves by rising distance. In a step, those of a leaf's vectors
        whose projections a query reaches are verified, for all queries of the leaf together; products that may be
        among the k best are taken again in one fixed order.
        """
        projected = self.space.project(q, asks=True)
        norms = ((q * self.space.scale) ** 2).sum(axis=1)
        squares = (projected * projected).sum(axis=1)
        boxes = to_boxes(projected, self.low, self.high)
        order = np.argsort(boxes, axis=1)
        away = np.take_along_axis(boxes, order, axis=1)
        floors, reach = floors.copy(), self.space.reach(norms, floors)
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((self.x * self.x).sum(axis=1).max())
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        live, at, step = np.arange(len(ids)), 0, 2
        while at < order.shape[1] and len(live := live[away[live, at] <= reach[live]]):
            row, place = np.nonzero(away[live, at : at + step] <= reach[live, None])
            row, leaf = live[row], order[live[row], at + place]
            by = np.argsort(leaf, kind="stable")
            row, leaf = row[by], leaf[by]
            cuts = np.concatenate((np.flatnonzero(np.diff(leaf, prepend=-1)), [len(leaf)]))
            some = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine, points = row[a:b], self.leaves[leaf[a]]
                part = slice(points[0], points[-1] + 1)
                apart = squares[mine, None] + self.squares[None, part] - 2 * projected[mine] @ self.projected[part].T
                i, j = np.nonzero(apart <= reach[mine, None])  # the others come after the stop
                self.verified += len(i)
                with np.errstate(over="ignore", invalid="ignore"):
                    dense = 4 * len(i) > apart.size
                    score = (q[mine] @ self.x[part].T)[i, j] if dense else np.einsum("ij,ij->i", q[mine[i]], self.x[points[j]])
                good = ~(score < (floors - slack)[mine[i]])
                some.append((mine[i[good]], points[j[good]]))
            row, point = (np.concatenate(c) for c in zip(*some, strict=True))
            other = self.ids[point] != ids[row]
            top = self._best(top, row[other], point[other], q, floors)
            full = np.bincount(top[0], minlength=len(ids)) == self.k
            lowest = np.full(len(ids), np.inf)
            np.minimum.at(lowest, top[0], top[2])
            floors = np.where(full, np.maximum(floors, lowest), floors)
            reach = self.space.reach(norms, floors)
            at, step = at + step, min(step * 2, 16)
        return top[0], self.ids[top[1]], top[2]

    def _best(self, top, row, point, q, floors):
        """The k best (row, point, score) of each row, of those so far and more."""
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.nan_to_num((self.x[point] * q[row]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        keep = score >= floors[row]
        row, point, score = (np.concatenate(c) for c in zip(top, (row[keep], point[keep], score[keep]), strict=True))
        by = np.lexsort((self.ids[point], -score, row))
        row, point, score = row[by], point[by], score[by]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row))) < self.k
        return row[best], point[best], score[best]


class Directory:
    """The spaces, the trees' upper levels and the cells' boxes of each length of vectors."""

    def __init__(self, spaces: dict[int, Space], nodes: dict[int, list]):
        self.spaces, self.nodes = spaces, nodes
        self.cells: dict[int, tuple] = {}

    def add(self, dim: int, cells: list[tuple]) -> None:
        cell, parts, low, high = zip(*cells, strict=True)
        self.cells[dim] = np.array(cell), np.array(parts), np.array(low), np.array(high)


def _place(directory):
    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                space = directory.value.spaces[int(dim)]
                projected = space.project(stacked(list(part["vec"])), asks=False)
                out = part.copy()
                out["cell"], out["place"] = descend(projected, directory.value.nodes[int(dim)]), list(projected)
                yield out

    return run


def _send(directory, first: bool):
    """Queries to their nearest cell, or to all others that the test leaves open."""

    def run(batches):
        for pdf in batches:
            for dim, whole in pdf.groupby("dim", sort=False):
                space = directory.value.spaces[int(dim)]
                cell, parts, low, high = directory.value.cells[int(dim)]
                for at in range(0, len(whole), _QUERIES):
                    part = whole.iloc[at : at + _QUERIES]
                    q = stacked(list(part["vec"]))
                    away = to_boxes(space.project(q, asks=True), low, high)
                    home = away.argmin(axis=1)
                    go = np.zeros(away.shape, bool)
                    if not first:
                        norms = ((q * space.scale) ** 2).sum(axis=1)
                        go = away <= space.reach(norms, part["floor"].to_numpy())[:, None]
                    go[np.arange(len(part)), home] = first
                    row, to = np.nonzero(go)
                    row, to = np.repeat(row, parts[to]), np.repeat(to, parts[to])
                    out = part.iloc[row][["vec_id", "dim", "vec", "floor"]].copy()
                    out["cell"] = cell[to]
                    starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(to, prepend=-1))
                    out["part"] = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row)))
                    out["asks"] = True
                    yield out

    return run


def _search(directory, k: int):
    def run(batches):
        current, tree, held = None, None, []
        for key, part in runs(batches, ["dim", "cell", "part"]):
            if key != current:
                current, tree, held = key, None, []
            asks = part["asks"].to_numpy()
            if not asks.all():  # a part's vectors come before its queries
                held.append((part["vec_id"].to_numpy()[~asks], stacked(list(part["vec"][~asks]))))
            if not asks.any() or not held:
                continue
            if tree is None:
                tree = Tree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), directory.value.spaces[int(key[0])], k)
            ids, floors = part["vec_id"].to_numpy()[asks], part["floor"].to_numpy()[asks]
            q = stacked(list(part["vec"][asks]))
            for at in range(0, len(ids), _QUERIES):
                s = slice(at, at + _QUERIES)
                row, near, score = tree.search(ids[s], q[s], floors[s])
                yield frame({"query_id": ids[s][row], "vec_id": near, "score": score})

    return run


def _directory(vectors: DataFrame, m: int, confidence: float, cell: int) -> Directory:
    stats = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("peak").alias("peak"), F.max("size").alias("size")).collect()
    sample = vectors.orderBy(F.hash("f1", "f2"), "f1", "f2").limit(SAMPLE).select("dim", "vec").toPandas()
    spaces = {r.dim: Space(r.dim, r.peak, r["size"], m, confidence) for r in stats}
    nodes = {}
    for r in stats:
        own = list(sample["vec"][sample["dim"] == r.dim])
        leaves = min(2 ** max(0, math.ceil(math.log2(r.n / cell))), CELLS, 2 ** int(math.log2(max(len(own), 1))))
        nodes[r.dim] = split(spaces[r.dim].project(stacked(own), asks=False), leaves) if own and leaves > 1 else []
    return Directory(spaces, nodes)


def nearest(rows: DataFrame, queries: Column, k: int = K, m: int = DIMENSIONS, confidence: float = CONFIDENCE, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``rows(vec_id, embedding)`` that meets ``queries`` the k others of largest inner product found."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    values = F.col("embedding").cast("array<double>")
    peak = F.array_max(F.transform(values, F.abs))
    size = F.log2("peak") + 0.5 * F.log2(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x / F.col("peak")) * (x / F.col("peak"))))
    chosen = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asks"), peak.alias("peak"))
    chosen = chosen.where("vec_id is not null and peak > 0").withColumn("size", size)
    vectors = packed(chosen, ("vec_id", "asks", "peak", "size"))
    vectors = vectors.groupBy("vec_id", "dim", "f1", "f2").agg(F.max("asks").alias("asks"), F.any_value("peak").alias("peak"), F.any_value("size").alias("size"), F.any_value("vec").alias("vec"))
    vectors = scratch.save(vectors, "vectors")
    directory = _directory(vectors, m, confidence, cell)
    plan = spark.sparkContext.broadcast(directory)
    base = vectors.select("vec_id", "dim", "vec")
    placed = scratch.save(base.mapInPandas(_place(plan), "vec_id long, dim int, vec binary, cell int, place array<double>"), "placed")
    ends = [f(F.get("place", F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(m)]
    boxes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), *ends).collect()
    for dim in {b.dim for b in boxes}:
        directory.add(dim, [(b.cell, b.parts, [b[f"low{i}"] for i in range(m)], [b[f"high{i}"] for i in range(m)]) for b in boxes if b.dim == dim])
    plan = spark.sparkContext.broadcast(directory)

    keys = ["dim", "cell", "part"]
    parts = spark.createDataFrame([(b.dim, b.cell, b.parts) for b in boxes], "dim int, cell int, parts int")
    members = placed.join(F.broadcast(parts), ["dim", "cell"]).select("vec_id", "dim", "vec", F.lit(-np.inf).alias("floor"), "cell", F.pmod(F.hash("vec_id"), "parts").alias("part"), F.lit(False).alias("asks"))

    def met(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInPandas(_send(plan, first), "vec_id long, dim int, vec binary, floor double, cell int, part int, asks boolean")
        dealt = members.union(sent).repartition(*keys).sortWithinPartitions(*keys, "asks")
        return dealt.mapInPandas(_search(plan, k), "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asked = vectors.where("asks").select("vec_id", "dim", "vec")
    near = scratch.save(met(asked.withColumn("floor", F.lit(-np.inf)), True), "near")
    floors = ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    again = asked.join(floors, "vec_id", "left").select("vec_id", "dim", "vec", F.coalesce("floor", F.lit(-np.inf)).alias("floor"))
    return ranked(near.union(met(again, False))).select("query_id", "rank", "vec_id", "score")


def recall(found: pd.DataFrame, truth: pd.DataFrame) -> float:
    """The part of the true neighbours, (query_id, vec_id) rows, that were found."""
    keys = ["query_id", "vec_id"]
    return len(truth[keys].merge(found[keys].drop_duplicates(), on=keys)) / max(len(truth), 1)
