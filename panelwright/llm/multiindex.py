"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, fitted independently on the halves of the unit vectors, form a product grid of cells. A
vector visits cells by multi-sequence traversal, in the order of a lower bound of the squared distance
between the vector and anything in the cell, the sum of one bound per half. Vectors of cosine c are
sqrt(2 - 2 c) apart, so a traversal that stops where the bound passes 2 - 2 c has met every partner:
target recall 1, the default. For a smaller ``recall`` the stop is measured: the bound at which that part
of the sample's linked pairs has met. Pairs met are verified by their cosine in double precision.

The bound of a half: a point of cell b is at least as near to b's centroid as to any other centroid c, so
it lies beyond the plane between them; the farthest of these planes counts.

The codebooks grow with the root of the number of vectors, so that a cell has about RESIDENTS vectors at
any size, up to MOST centroids a half. They are fitted on a sample of at most SAMPLE rows (those with the
smallest hashes); every row is indexed and is a query.

Equal vectors of one label are one representative that counts as often as it occurs. The grid of a label is
divided, in the order of its cells, into blocks for about BLOCK vectors each, and a block with more residents
is cut into parts, so a vector travels to the few blocks that hold its cells instead of to each cell. A pair
is verified in the block of the one that comes later by (cell, id), and there once. A task holds a part of a
block and streams what visits it. It keeps of the links it finds their number per vector and, for
connectivity, each vector's link to its first partner of the part and those between the first and the
others, each once.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows
without a label are linked with nothing; only vectors of equal length are compared; repeated rows count
as vectors of their own. A null vec_id stays alone: component null, kept. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.base import Scratch, components, join_measured
from panelwright.llm.vectors import frame, packed, runs, stacked

COSINE = 0.93
SAMPLE = 8192
#: Centroids per half, and the vectors a cell is to have.
LEAST, MOST, RESIDENTS = 8, 256, 128
BLOCK = 4096
_BATCH = 1024
#: Above the number of a block's residents.
_WIDE = 1 << 20


def _units(cells) -> np.ndarray:
    x = stacked(cells)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares nor norms overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; empty centroids keep their place."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
    return np.unique(c, axis=0)


def centroids(n: int) -> int:
    """Centroids per half for n vectors."""
    return int(min(max(round((n / RESIDENTS) ** 0.5), LEAST), MOST))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def fit(rows: DataFrame, k: int, cosine: float = COSINE, recall: float = 1.0) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], float]:
    """(codebooks of both halves by vector length, bound at which a traversal stops), from at most SAMPLE rows."""
    sample = rows.select("label", "dim", "vec").orderBy(F.hash("f1", "f2"), "f1", "f2").limit(SAMPLE).toPandas()
    books = {int(dim): tuple(_kmeans(h, k) for h in _halves(_units(list(part["vec"])))) for dim, part in sample.groupby("dim")}
    return books, (2 - 2 * cosine if recall >= 1 else measured_stop(sample, books, cosine, recall)) + 1e-9


def measured_stop(sample, books, cosine: float, recall: float) -> float:
    """The bound within which this part of the sample's linked pairs meet; the proven one if it has none."""
    met = []
    for (_, dim), part in sample.groupby(["label", "dim"]):
        x = _units(list(part["vec"]))
        (o1, b1), (o2, b2) = (half_bounds(h, c) for h, c in zip(_halves(x), books[int(dim)], strict=True))
        cell = o1 * len(books[int(dim)][1]) + o2
        for at in range(0, len(x), _BATCH):
            i, j = np.nonzero(x[at : at + _BATCH] @ x.T >= cosine)
            i += at
            later = (i != j) & (cell[i] <= cell[j])
            met.append(b1[i[later], o1[j[later]]] + b2[i[later], o2[j[later]]])
    met = np.concatenate(met) if met else np.zeros(0)
    return float(np.quantile(met, recall, method="higher")) if len(met) else 2 - 2 * cosine


def half_bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own centroid, lower bound of the squared distance to each centroid's cell)."""
    d = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]).clip(0)
    apart = 2 * np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(apart, np.inf)
    apart[apart == 0] = np.inf
    beyond = np.empty_like(d)
    step = max(1, (1 << 22) // len(c) ** 2)
    for at in range(0, len(x), step):
        s = slice(at, at + step)
        beyond[s] = ((d[s, :, None] - d[s, None, :]) / apart[None]).max(axis=2, initial=0)
    return d.argmin(1), np.maximum(beyond - 1e-9, 0) ** 2


def multi_sequence(b1: np.ndarray, b2: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) of the cells that rows visit, each row's in the order of b1[row, i] + b2[row, j], up to the limit.

    All rows walk in lockstep. For each i, by rising bound, ``after`` is the next j on its frontier; a step takes each
    row's nearest frontier cell, moves that i on to its next j and opens the next i if this was its first.
    """
    o1, o2 = np.argsort(b1, axis=1, kind="stable"), np.argsort(b2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(b1, o1, 1), np.take_along_axis(b2, o2, 1)
    (n, k1), k2 = s1.shape, s2.shape[1]
    after, cost = np.zeros((n, k1), np.int64), np.full((n, k1), np.inf)
    cost[:, 0] = s1[:, 0] + s2[:, 0]
    live, met = np.arange(n), []
    while len(live):
        i = cost[live].argmin(1)
        near = cost[live, i] <= limit
        live, i = live[near], i[near]
        j = after[live, i]
        met.append((live, o1[live, i], o2[live, j]))
        after[live, i] = j + 1
        cost[live, i] = np.where(j + 1 < k2, s1[live, i] + s2[live, np.minimum(j + 1, k2 - 1)], np.inf)
        opens = (j == 0) & (i + 1 < k1)
        row, new = live[opens], i[opens] + 1
        cost[row, new] = s1[row, new] + s2[row, 0]
    return tuple(np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64),) * 3


def _place(rows: DataFrame, books, limit: float) -> DataFrame:
    """Adds each row's own cell and the cells it visits, in that order, from its own on."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    cols = ["rep", "label", "dim", "n", "vec"]

    def visits(x, book):
        (o1, b1), (o2, b2) = (half_bounds(h, c) for h, c in zip(_halves(x), book, strict=True))
        width = len(book[1])
        own = o1 * width + o2
        row, i, j = multi_sequence(b1, b2, limit)
        cell = i * width + j
        later = cell >= own[row]  # of a pair, the one in the earlier cell visits the other
        row, cell = row[later], cell[later]
        order = np.argsort(row, kind="stable")
        return own, np.split(cell[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])

    def run(batches):
        for pdf in batches:
            for dim, whole in pdf.groupby("dim", sort=False):
                for at in range(0, len(whole), _BATCH):
                    part = whole.iloc[at : at + _BATCH]
                    out = part[cols].copy()
                    if (book := shared.value.get(int(dim))) is None:
                        out["cell"], out["grid"], out["visits"] = 0, 1, [[0]] * len(out)
                    else:
                        out["grid"] = len(book[0]) * len(book[1])
                        out["cell"], out["visits"] = visits(_units(list(part["vec"])), book)
                    yield out[[*cols, "cell", "grid", "visits"]]

    types = dict(rows.dtypes)
    return rows.select(*cols).mapInPandas(run, ", ".join([f"`{c}` {types[c]}" for c in cols] + ["cell int, grid int, visits array<int>"]))


class _Block:
    """The residents of a block; compares them with what comes along."""

    def __init__(self, cosine: float):
        self.cosine, self._parts, self._told = cosine, [], np.zeros(0, np.int64)
        self.ids = None

    def add(self, part) -> None:
        self._parts.append(part)

    def settle(self):
        """All residents have come: their links with each other."""
        if self.ids is None:
            self.ids, self.n, self.cells, self.units = (np.concatenate(x) for x in zip(*map(_columns, self._parts), strict=True)) if self._parts else (np.zeros(0, np.int64),) * 3 + (None,)
            for part in self._parts:
                yield from self.meet(part)
            self._parts = []

    def meet(self, part):
        if self.units is None:
            return
        all_ids, all_n, all_cells, all_units = _columns(part)
        for a in range(0, len(all_ids), _BATCH):
            s = slice(a, a + _BATCH)
            x_ids, x_n, x_cells = all_ids[s], all_n[s], all_cells[s]
            hit = all_units[s] @ self.units.T >= self.cosine
            later = x_cells[:, None] < self.cells[None, :]
            hit &= later | (x_cells[:, None] == self.cells[None, :]) & (x_ids[:, None] < self.ids[None, :])
            xi, yi = np.nonzero(hit)
            if not len(xi):
                continue
            own = np.bincount(xi, self.n[yi], len(x_ids)).astype(np.int64)
            their = np.bincount(yi, x_n[xi], len(self.ids)).astype(np.int64)
            linked, theirs = np.flatnonzero(own), np.flatnonzero(their)
            yield frame({"u": np.concatenate((x_ids[linked], self.ids[theirs])), "v": -1, "links": np.concatenate((own[linked], their[theirs]))})
            starts = np.flatnonzero(np.diff(xi, prepend=-1))
            first_of = yi[np.repeat(starts, np.diff(starts, append=len(xi)))]
            codes = np.setdiff1d(np.unique(first_of * _WIDE + yi), self._told, assume_unique=True)
            self._told = np.union1d(self._told, codes)
            m, y = codes // _WIDE, codes % _WIDE
            pick = m != y
            yield frame({"u": np.concatenate((x_ids[xi[starts]], self.ids[y[pick]])), "v": np.concatenate((self.ids[yi[starts]], self.ids[m[pick]])), "links": 0})


def _columns(part):
    return part["rep"].to_numpy(), part["n"].to_numpy(), part["cell"].to_numpy(), _units(list(part["vec"]))


def _meet(cosine: float):
    def run(batches):
        current, block = None, None
        for key, part in runs(batches, ["label", "dim", "block", "part"]):  # residents come before visitors
            if key != current:
                if block is not None:
                    yield from block.settle()
                current, block = key, _Block(cosine)
            visits = part["visitor"].to_numpy()
            if not visits.all():
                block.add(part[~visits])
            if visits.any():
                yield from block.settle()
                yield from block.meet(part[visits])
        if block is not None:
            yield from block.settle()

    return run


def _block(cell):
    """The block of a cell: as many equal ranges of cells as a label has blocks."""
    return F.floor(cell.cast("long") * F.col("blocks") / F.col("grid")).cast("int")


def _blocks(placed: DataFrame) -> DataFrame:
    """(label, dim, blocks, parts): the number of blocks of a label and length, and of the parts of each block."""
    keys = ["label", "dim"]
    totals = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.max("grid").alias("grid"))
    cells = placed.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("size"))
    sizes = cells.join(totals, keys).groupBy(*keys, _block(F.col("cell")).alias("block")).agg(F.sum("size").alias("size"))
    every = totals.select(*keys, "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    parts = every.join(sizes, [*keys, "block"], "left").select(*keys, "blocks", F.struct("block", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(0)).cast("int").alias("parts")).alias("p"))
    return parts.groupBy(*keys, "blocks").agg(F.sort_array(F.collect_list("p")).alias("p")).select(*keys, "blocks", F.transform("p", lambda p: p["parts"]).alias("parts"))


def near_vectors(rows: DataFrame, cosine: float = COSINE, recall: float = 1.0, k: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows(vec_id, embedding, label)``; ``k`` centroids a half instead of ``centroids``."""
    scratch = Scratch(rows.sparkSession)
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    some = F.exists(F.col("embedding"), lambda x: x != 0)
    vectors = scratch.save(packed(ids.where("label is not null and vec_id is not null").where(some), ("vec_id", "label")), "vectors")
    same = ["label", "dim", "f1", "f2"]
    firsts = vectors.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    of = scratch.save(vectors.select("vec_id", *same).join(firsts, same).select("vec_id", "rep", "n"), "of")
    chosen = vectors.join(firsts.withColumnRenamed("rep", "vec_id"), [*same, "vec_id"]).dropDuplicates(same)
    books, limit = fit(vectors, k or centroids(vectors.count()), cosine, recall)
    placed = scratch.save(_place(chosen.withColumnRenamed("vec_id", "rep"), books, limit), "placed")
    blocks = scratch.save(_blocks(placed), "blocks")
    rows = join_measured(placed, blocks, ["label", "dim"], "inner", blocks.agg(F.sum("blocks")).first()[0] or 0)
    home = _block(F.col("cell"))
    rows = rows.withColumns({"home": home, "own": F.pmod(F.hash("rep"), F.get("parts", home))})
    to = F.array_distinct(F.transform("visits", lambda c: _block(c)))
    trip = lambda b, p: F.struct(b.alias("block"), p.alias("part"), ((b != F.col("home")) | (p != F.col("own"))).alias("visitor"))
    held = F.filter(to, lambda b: F.get("parts", b) > 0)
    trips = F.flatten(F.transform(held, lambda b: F.transform(F.sequence(F.lit(0), F.get("parts", b) - 1), lambda p: trip(b, p))))
    base = ["rep", "label", "dim", "n", "vec", "cell"]
    meeting = rows.select(*base, F.explode(trips).alias("t")).select(*base, "t.block", "t.part", "t.visitor")
    keys = ["label", "dim", "block", "part"]
    meeting = meeting.repartition(*keys).sortWithinPartitions(*keys, "visitor")
    found = scratch.save(meeting.mapInPandas(_meet(cosine), "u long, v long, links long"), "found")
    links = found.where("links > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    comps = components(scratch, found.where("links = 0").select("u", "v"), "vectors").select(F.col("node").alias("rep"), "label")
    own = of.join(links, "rep", "left").join(comps, "rep", "left")
    # an id on several rows has one component, and the most links of its rows
    own = own.groupBy("vec_id").agg(F.max(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.min(F.coalesce("label", "rep")).alias("label"))
    component = F.coalesce("label", "vec_id")
    return ids.select("vec_id").join(own, "vec_id", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def oracle(cosine: float = COSINE) -> str:
    """DuckDB SQL of ``near_vectors``."""
    return f"""
with recursive good as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select a.vec_id as u, b.vec_id as v from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= {cosine!r}),
reach(id, low) as (select u, v from links union select r.id, l.v from reach r join links l on r.low = l.u),
lows as (select id, min(low) as low from reach group by id),
counts as (select u, count(*) as n from links group by u)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) as component_id,
  e.vec_id <= coalesce(l.low, e.vec_id) as kept
from embeddings e left join counts c on c.u = e.vec_id left join lows l on l.id = e.vec_id
"""
