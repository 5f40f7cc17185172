"""Exact top-k inner product search with multi-resolution segment statistics.

Vectors are cut into 4, then 16, then 32 segments. With a segment's mean and deviation (times the root of its
length) the Cauchy-Schwarz inequality gives for each segment

    (q - c)^2 >= len * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2)

and, with the norms, an upper bound of the inner product: |q|^2 + |c|^2 - 2 q.c = (q - c)^2. A query's k-th
best score so far is its threshold; the first comes from the exact scores of the candidates with the
largest products of segment means. Candidates whose bound falls short of the threshold drop out, coarse to
fine. Survivors are scored exactly in the order of their bounds, largest first, in growing steps: the
threshold rises, and the rest is left as soon as the next bound falls short of it. A bound equal to the
threshold survives, so ties go to the smaller id.

Queries and candidates meet in a grid: candidates are dealt by a hash of their id to shards of about
SHARD rows, queries to blocks of about QUERIES rows; a block and a shard meet in one task that holds
the block and streams the shard. A query meets one shard first, and the others with the threshold that it has
from there, so that each of them profits from what is known. Each task returns at most k rows per query, and
the best of these are ranked.

Exactness: sums whose parts may pass 2**52 are taken over 64-bit integers, and those that may pass 2**62
over Python's integers, without bounds. A score beyond a long is ranked by its exact value and given as the
largest or smallest long.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; only vectors
of equal length are compared; a query with fewer than k candidates gets them all; rows with the query's own
vec_id are not its candidates; of rows with one vec_id those with equal scores count once, so repeated rows do;
null ids take no part. A component whose multiple by the scale is not finite takes its vector out like a
non-finite one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.base import Scratch, join_measured
from panelwright.llm.vectors import frame, packed, runs, stacked

K = 20
SCALE = 64
LEVELS = (4, 16, 32)
SHARD, QUERIES = 16_384, 8_192
_BATCH, _ROWS = 4096, 64
#: Candidates scored first, without a threshold, and in the first step after it.
_SEEDS, _STEP = 64, 128
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(cells, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * stacked(cells))


def segment_features(x: np.ndarray, pieces: int) -> np.ndarray:
    """Root of the length times mean and deviation of each segment; inner products of these bound those of x."""
    out = []
    for s in np.array_split(x, min(pieces, x.shape[1]), axis=1):
        mean = s.mean(axis=1)
        out += [mean * np.sqrt(s.shape[1]), np.sqrt(((s - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def sortable(x: int) -> bytes:
    """Bytes that sort like the integers."""
    size = (abs(x).bit_length() + 8) // 8
    head = (0x80000000 + (size if x >= 0 else -size)).to_bytes(4, "big")
    return head + (x + (1 << 8 * size) * (x < 0)).to_bytes(size, "big")


class TopK:
    """The k best (score, id) of each query of a block. ``pairs`` and ``scored`` count what met and what was scored."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floors: dict[int, int] | None = None):
        """``floors`` has for some query rows the k-th best score among other candidates: lower ones needn't be found."""
        self.ids, self.x, self.k = ids, x, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.levels = [segment_features(x, n) for n in LEVELS]
            self.norms = np.sqrt((x**2).sum(1))
        self.top = np.zeros((0, 3), np.int64)  # query row, score, id
        self.least = np.full(len(ids), -np.inf)
        self.sizes = np.abs(x).max(axis=1, initial=0)
        self.wide: dict[int, set[tuple[int, int]]] = {}  # query row -> (-score, id) of sums over Python's integers
        self.pairs = self.scored = 0
        for q, score in (floors or {}).items():
            self._raise(q, score)

    def offer(self, ids: np.ndarray, y: np.ndarray) -> None:
        sizes = np.abs(y).max(axis=1, initial=0)
        # vectors whose products with the largest of the other side may not fit; few or none in most tables
        long = 2.0**62 / y.shape[1]
        big_y = sizes * np.minimum(self.sizes.max(initial=0), np.sqrt(long)) >= long
        big_q = self.sizes * np.where(big_y, 0, sizes).max(initial=0) >= long
        if big_y.any() or big_q.any():
            self._offer_wide(np.arange(len(self.ids)), ids[big_y], y[big_y])
            self._offer_wide(np.flatnonzero(big_q), ids[~big_y], y[~big_y])
        self._offer(np.flatnonzero(~big_q), ids[~big_y], y[~big_y])

    def _offer_wide(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        theirs = [[int(v) for v in row] for row in y]
        for q in rows.tolist() if len(ids) else []:
            own = [int(v) for v in self.x[q]]
            best = self.wide.setdefault(q, set())
            best.update((-sum(map(int.__mul__, own, c)), i) for i, c in zip(ids.tolist(), theirs, strict=True) if i != self.ids[q])
            self.wide[q] = set(sorted(best)[: self.k])
            self.pairs += len(ids)
            self.scored += len(ids)

    def _offer(self, queries: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        if not len(ids) or not len(queries):
            return
        features = [segment_features(y, n) for n in LEVELS]
        # the smallest type whose sums are exact
        most = self.sizes[queries].max(initial=0) * np.abs(y).max(initial=0) * y.shape[1]
        kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**52 else np.int64
        fits = np.where(self.sizes[:, None] < 2.0**62, self.x, 0)  # queries with larger components are not asked here
        own, theirs = fits.astype(kind), y.astype(kind)
        # float sums of a bound err by far less than this part of the norms' product
        slack = 1e-9 * (1 + self.norms * np.sqrt((y**2).sum(1).max(initial=0)))
        distinct = np.zeros(len(ids), bool)
        distinct[np.unique(ids, return_index=True)[1]] = True
        found, n = [], 0
        for at in range(0, len(queries), _ROWS):
            rows = queries[at : at + _ROWS]
            self._seed(rows, ids, own, theirs, features, distinct, found)
            live = ids[None, :] != self.ids[rows][:, None]
            self.pairs += int(live.sum())
            cols, bound = np.arange(len(ids)), None
            for mine, other in zip(self.levels, features, strict=True):
                if not len(cols):
                    break
                bound = mine[rows] @ other[cols].T
                live = live & (bound >= (self.least[rows] - slack[rows])[:, None])
                some = live.any(axis=0)
                if some.mean() < 0.7:  # finer levels look at what some query of the rows still needs
                    cols, live, bound = cols[some], live[:, some], bound[:, some]
            for k, q in enumerate(rows.tolist() if len(cols) else []):
                if len(mine := np.flatnonzero(live[k])):
                    n += self._survivors(q, cols[mine], bound[k, mine], slack[q], ids, own, theirs, distinct, found)
            if n > 1 << 18:
                self._merge(found)
                found, n = [], 0
        self._merge(found)

    def _seed(self, rows, ids, own, theirs, features, distinct, found) -> None:
        """First thresholds, from the candidates of the largest products of segment means."""
        rows = rows[~np.isfinite(self.least[rows])]
        if not len(rows) or distinct.sum() <= self.k:
            return
        once = np.flatnonzero(distinct)
        means = self.levels[-1][rows][:, ::2] @ features[-1][once][:, ::2].T
        means[ids[once][None, :] == self.ids[rows][:, None]] = -np.inf
        n = min(len(once), max(_SEEDS, self.k + 1))
        near = np.argpartition(means, -n, axis=1)[:, -n:]
        for k, q in enumerate(rows.tolist()):
            c = once[near[k]]
            c = c[ids[c] != self.ids[q]]
            if len(c) >= self.k:
                score = theirs[c] @ own[q]
                self.scored += len(c)
                self._raise(q, np.partition(score, -self.k)[-self.k])

    def _survivors(self, q: int, c: np.ndarray, bound: np.ndarray, slack: float, ids, own, theirs, distinct, found) -> int:
        """Exact scores of candidates ``c`` of query row q, largest bound first, as long as the bound reaches the threshold."""
        if len(c) > _STEP:
            order = np.argsort(-bound)
            c, bound = c[order], bound[order]
        at, step, best, n = 0, _STEP, np.zeros(0, own.dtype), 0
        while at < len(c) and bound[at] >= self.least[q] - slack:
            part = c[at : at + step]
            score = theirs[part] @ own[q]
            self.scored += len(part)
            keep = score >= self.least[q]
            part, score = part[keep], score[keep]
            if len(part):
                found.append(np.stack((np.full(len(part), q), score.astype(np.int64), ids[part]), axis=1))
                n += len(part)
                # different candidates only, so that k of them reach the threshold whatever rows are repeated
                best = np.concatenate((best, score[distinct[part]]))
                if len(best) >= self.k:
                    best = np.partition(best, -self.k)[-self.k :]
                    self._raise(q, best[0])
            at, step = at + step, step * 2
        return n

    def _raise(self, q: int, score) -> None:
        """A threshold from a k-th best score; of an integer that no double holds, the next double below."""
        as_float = float(score)
        self.least[q] = max(self.least[q], as_float if abs(as_float) < 2.0**53 else np.nextafter(as_float, -np.inf))

    def _merge(self, found: list[np.ndarray]) -> None:
        if not found:
            return
        rows = np.concatenate([self.top, *found])
        # what can't be among a query's best goes before the sort
        rows = rows[rows[:, 1] >= self.least[rows[:, 0]]]
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        again = np.zeros(len(rows), bool)
        again[1:] = (rows[1:] == rows[:-1]).all(axis=1)
        rows = rows[~again]
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
        self.top = rows[place < self.k]

    def results(self):
        """(query_id, vec_id, score, exact) rows; ``exact`` orders scores that no long can hold."""
        t = self.top
        out = [(self.ids[t[:, 0]], t[:, 2], t[:, 1], np.full(len(t), None, object))]
        for q, best in self.wide.items():
            scores = [-s for s, _ in best]
            exact = [sortable(s) if not _LEAST < s < _MOST else None for s in scores]
            out.append((np.full(len(best), self.ids[q]), np.array([i for _, i in best], np.int64), np.array([min(max(s, _LEAST), _MOST) for s in scores], np.int64), np.array([*exact, None], object)[:-1]))
        return [frame(dict(zip(("query_id", "vec_id", "score", "exact"), x, strict=True))) for x in out if len(x[0])]


def _search(k: int, scale: int):
    def run(batches):
        current, block, ids, vecs, known, held, pending = None, None, [], [], [], [], 0

        def flush():
            nonlocal held, pending, block
            if block is None and ids:
                floors = {q: int(f) for q, f in enumerate(f for part in known for f in part) if not pd.isna(f)}
                block = TopK(np.concatenate(ids), np.concatenate(vecs), k, floors)
            if held and block is not None:
                i, y = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                for at in range(0, len(i), _BATCH):
                    block.offer(i[at : at + _BATCH], y[at : at + _BATCH])
            held, pending = [], 0

        def results():
            flush()
            if block is not None:
                yield from block.results()

        for key, part in runs(batches, ["dim", "block", "shard"]):
            if key != current:
                yield from results()
                current, block, ids, vecs, known = key, None, [], [], []
            asks = part["candidate"].to_numpy() == 0
            x, i = quantised(list(part["vec"]), scale), part["vec_id"].to_numpy()
            if asks.any():
                ids.append(i[asks])
                vecs.append(x[asks])
                known.append(part["floor"][asks].tolist())
            if not asks.all():
                held.append((i[~asks], x[~asks]))
                pending += int((~asks).sum())
                if pending >= _BATCH:
                    flush()
        yield from results()

    return run


def top_k(rows: DataFrame, queries: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row of ``rows(vec_id, embedding)`` that meets ``queries``, which may use any column."""
    scratch = Scratch(rows.sparkSession)
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asks"))
    finite = F.forall(F.col("embedding"), lambda x: F.abs(x.cast("double") * scale) < float("inf"))
    vectors = packed(ids.where("vec_id is not null").where(finite), ("vec_id", "asks")).select("vec_id", "dim", "vec", "asks")
    vectors = scratch.save(vectors, "vectors")
    sizes = scratch.save(vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"), F.ceil(F.count_if("asks") / QUERIES).cast("int").alias("blocks")), "sizes")
    dealt = join_measured(vectors, sizes, "dim", "inner", sizes.count())
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.hash("vec_id"), n)
    keys = ["dim", "block", "shard"]
    asked = dealt.where("asks").select("vec_id", "dim", "vec", own("blocks").alias("block"), own("shards").alias("home"), each("shards").alias("shards"))
    offered = dealt.where("blocks > 0").select("vec_id", "dim", "vec", F.explode(each("blocks")).alias("block"), own("shards").alias("shard"), F.lit(None).cast("long").alias("floor"), F.lit(1).alias("candidate"))

    def met(queries_: DataFrame) -> DataFrame:
        grid = queries_.select("vec_id", "dim", "vec", "block", "shard", F.col("floor").cast("long").alias("floor"), F.lit(0).alias("candidate")).union(offered)
        sorted_ = grid.repartition(*keys).sortWithinPartitions(*keys, "candidate")
        return sorted_.mapInPandas(_search(k, scale), "query_id long, vec_id long, score long, exact binary")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("exact"), "vec_id")
    ranked = lambda found: found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    near = scratch.save(met(asked.withColumns({"shard": F.col("home"), "floor": F.lit(None)})), "near")
    # a score that no long holds is no threshold
    floors = ranked(near).where((F.col("rank") == k) & F.col("exact").isNull()).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    others = F.explode(F.filter("shards", lambda x: x != F.col("home"))).alias("shard")
    rest = asked.join(floors, "vec_id", "left").select("vec_id", "dim", "vec", "block", others, "floor")
    return ranked(near.union(met(rest))).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = K, scale: int = SCALE, every: int = 20) -> str:
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select distinct q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and q.vec_id % {every} = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= {k}
"""
