"""Language-model scoring with an Elias-Fano n-gram trie.

The model has n-grams up to ORDER, with absolute discounting, interpolated down to add-one unigrams:

    p(w | h) = max(c(h, w) - D, 0) / c(h) + D * t(h) / c(h) * p(w | h'),    p(w) = (c(w) + 1) / (N + V + 1)

with h' the context without its first word, t(h) the number of different successors of h and c(h) how often
it has one. The first token of a text has a context of its own, the begin of a text; contexts of two and
more words lie within the text. Texts end with an end token. All counts are taken over all training
documents; nothing is pruned.

Level 1 of the trie holds the words, as 64-bit hashes in ascending order (a word's id is its rank): the
hashes and the running sums of the counts are Elias-Fano coded, log probabilities quantised to 16 bits.
Level n holds the n-grams. Their parents are the nodes of level n - 1 (of level 2: the words and the begin);
Elias-Fano pointers lead from parents to successors, whose word ids are raised by the last value of the
parent before, so that the whole sequence is monotone and Elias-Fano coded, with 16-bit quantised log
probabilities of successors and log backoff weights of parents. An n-gram is found by a successor search for
its word relative to its parent's base. A level is cut into shards by equal ranges of parents, at least one for
SHARD tokens. From level 3 on a frequent word's continuations have many parents and lie in many shards; at
level 2 all different successors of one word lie in one. Shards are files in the shared folder that tasks map
into memory.

A level is counted by walking the levels above: each token's context node and its probability so far, which
the next order discounts into, are at hand. Counting merges sorted arrays within each task, sends each
shard's part as one compact row, and merges again, so a frequent n-gram costs one entry per task.

Edge cases: null and empty texts consist of the end token; with no training documents every token has
probability 1; a null doc_id is held out; repeated rows are learned and scored each; other columns are
ignored. Words are told apart by 64-bit hashes (see ``base``), n-grams by their words.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.base import Files, Scratch, batch_word_hashes, portions
from panelwright.llm.eliasfano import EliasFano
from panelwright.llm.vectors import runs

ORDER = 3
DISCOUNT = 0.8
#: Entries that a counting task holds before it merges, and before it sends what it has.
MERGE, SEND = 1 << 20, 1 << 22
#: Characters tokenised at once.
TEXTS = 1 << 21
#: Training tokens to a shard, at most.
SHARD = 1 << 22
#: Log10 probabilities are quantised in steps of FLOOR / 65535, from 0 down to -FLOOR.
FLOOR = 16.0
_END = np.uint64(0x5BD1E995CA11AB1E)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text, modulo 7, is 2 (also for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(True))


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10, 0, FLOOR) * (65535 / FLOOR)).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * (-FLOOR / 65535)


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with an end token after each text, bounds)."""
    h, bounds = batch_word_hashes(texts)
    return np.insert(h, bounds[1:], _END), bounds + np.arange(len(bounds))


class Counter:
    """Counts of word hashes, as a sorted array."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self._waiting.append((keys, counts))
        self._size += len(keys)
        if self._size > MERGE + len(self.keys):
            self.merge()

    def merge(self) -> None:
        if not self._waiting:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self._waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self._waiting]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        self._waiting, self._size = [], 0


# ---------------------------------------------------------------- files of a shard


def _store(folder: str, parts: list[np.ndarray], **about) -> str:
    """Arrays in one file: a header with their types and sizes, then each at a multiple of 8 bytes."""
    name = f"{uuid.uuid4().hex}.trie"
    head = json.dumps(about | {"parts": [(p.dtype.str, len(p)) for p in parts]}).encode()
    head += b" " * (-len(head) % 8)
    with Files(folder).create(name) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for p in parts:
            data = p.tobytes()
            out.write(data + bytes(-len(data) % 8))
    return name


#: Headers and arrays of files already mapped by this worker.
_mapped: dict[tuple[str, str], tuple[dict, list[np.ndarray]]] = {}


def _fetch(folder: str, name: str) -> tuple[dict, list[np.ndarray]]:
    if (folder, name) in _mapped:
        return _mapped[folder, name]
    files = Files(folder)
    data = files.bytes(name)
    size = int.from_bytes(data[:8].tobytes(), "little")
    about, at, parts = json.loads(data[8 : 8 + size].tobytes()), 8 + size, []
    for kind, n in about["parts"]:
        length = n * np.dtype(kind).itemsize
        parts.append(data[at : at + length].view(kind))
        at += length + -length % 8
    if files.local:  # what remote files hold is kept by ``Files``, within its bound
        if len(_mapped) >= 4096:
            _mapped.clear()
        _mapped[folder, name] = about, parts
    return about, parts


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


# ---------------------------------------------------------------- level 1


def _first_hash(shard: int, shards: int) -> np.uint64:
    """The smallest hash of a shard."""
    return np.uint64(-(-(shard << 32) // shards) << 32)


def _count_words(shards: int):
    def run(batches):
        held = Counter()

        def send():
            held.merge()
            cut = np.searchsorted(_shard_of(held.keys, shards), np.arange(shards + 1, dtype=np.uint64))
            rows = [(s, held.keys[a:b].tobytes(), held.counts[a:b].astype(np.uint32 if held.counts[a:b].max() < 1 << 32 else np.uint64).tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pd.DataFrame(rows, columns=["shard", "keys", "counts"])

        for pdf in batches:
            for _, texts in portions(pdf["text"], TEXTS):
                held.add(token_hashes(texts)[0])
                if len(held.keys) > SEND:
                    yield send()
                    held = Counter()
        yield send()

    return run


def _counts(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, np.uint64)
    return k, np.frombuffer(counts, np.uint32 if len(counts) < 8 * len(k) else np.uint64).astype(np.int64)


def _build_words(folder: str, shards: int):
    def run(batches):
        current, held = None, None

        def finish():
            held.merge()
            first = _first_hash(current, shards)
            hashes, sums = EliasFano.build(held.keys - first), EliasFano.build(np.concatenate(([0], np.cumsum(held.counts))))
            name = _store(folder, [*hashes.parts, *sums.parts, quantise(-np.log10(held.counts + 1.0))], sizes=[hashes.n, hashes.low_bits, sums.n, sums.low_bits])
            return pd.DataFrame([(current, name, len(held.keys), int(held.counts.sum()))], columns=["shard", "file", "n", "total"])

        for (shard,), part in runs(batches, ["shard"]):
            if shard != current:
                if current is not None:
                    yield finish()
                current, held = int(shard), Counter()
            for k, c in zip(part["keys"], part["counts"], strict=True):
                held.add(*_counts(k, c))
        if current is not None:
            yield finish()

    return run


class Words:
    """Level 1: ids, counts and log10 probabilities of word hashes."""

    def __init__(self, folder: str, table: list[tuple[int, str, int, int]], shards: int):
        self.shards, self.folder = shards, folder
        self.file = {s: f for s, f, _, _ in table}
        size = np.zeros(shards + 1, np.int64)
        for s, _, n, _ in table:
            size[s + 1] = n
        self.base = np.cumsum(size)
        self.n, self.total = int(self.base[-1]), sum(t for *_, t in table)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, count, log10 p) of each hash; id -1 and count 0 if unknown."""
        u, inverse = np.unique(hashes, return_inverse=True)
        ids, counts, logs = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64), np.zeros(len(u))
        cut = np.searchsorted(_shard_of(u, self.shards), np.arange(self.shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if s not in self.file:
                continue
            about, p = _fetch(self.folder, self.file[s])
            n1, b1, n2, b2 = about["sizes"]
            keys, sums = EliasFano(n1, b1, *p[0:4]), EliasFano(n2, b2, *p[4:8])
            part = slice(cut[s], cut[s + 1])
            want = u[part] - _first_hash(s, self.shards)
            at = keys.find(want)
            hit = at >= 0
            at, where = at[hit], cut[s] + np.flatnonzero(hit)
            ids[where], logs[where] = self.base[s] + at, -restore(p[8][at])
            before, upto = sums.get_pairs(at)
            counts[where] = (upto - before).astype(np.int64)
        return ids[inverse], counts[inverse], (logs - np.log10(self.total + self.n + 1))[inverse]


# ---------------------------------------------------------------- levels from 2 on


def ordered(a: np.ndarray, b: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts pairs of uint64, places of the first of each distinct pair); ``kind`` 'stable' merges sorted runs."""
    bits = int(b.max(initial=0)).bit_length()
    # one sort of packed pairs wherever they fit 64 bits
    order = np.argsort(a << np.uint64(bits) | b, kind=kind) if int(a.max(initial=0)).bit_length() + bits <= 64 else np.lexsort((b, a))
    x, y = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, np.flatnonzero(first)


class Grams:
    """Counts of (parent, word), sorted, with the quantised log10 probability of the word one order below."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._size = self._whole = 0

    def add(self, parent: np.ndarray, word: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> None:
        order, first = ordered(parent, word, None if counts is None else "stable")
        n = np.diff(first, append=len(order)) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts
        keep = order[first]
        self._parts.append((parent[keep], word[keep], low[keep], n))
        self._size += len(keep)
        if self._size > MERGE + 2 * self._whole:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        """(parents, words, low, counts)."""
        if len(self._parts) != 1:
            none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64))
            whole = [np.concatenate(x) for x in zip(*(self._parts or [none]), strict=True)]
            self._parts, self._size = [], 0
            self.add(*whole)
        self._whole = self._size
        return self._parts[0]

    @property
    def size(self) -> int:
        return self._size


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64).tobytes()


def _widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.uint64).astype(np.uint64)


_GRAMS = "shard int, n long, parents binary, lengths binary, words binary, low binary, counts binary"


def _count_grams(shared, cuts: np.ndarray):
    def run(batches):
        trie: Trie = shared.value
        held = Grams()

        def send():
            parent, word, low, counts = held.merge()
            rows = []
            cut = np.searchsorted(parent, cuts.astype(np.uint64))
            for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if b > a:
                    own = parent[a:b] - np.uint64(cuts[s])
                    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    c = counts[a:b]
                    rows.append((s, b - a, _narrow(own[starts]), np.diff(starts, append=b - a).astype(np.uint32).tobytes(), _narrow(word[a:b]), low[a:b].tobytes(), c.astype(np.uint8 if c.max() < 256 else np.int64).tobytes()))
            return pd.DataFrame(rows, columns=["shard", "n", "parents", "lengths", "words", "low", "counts"])

        for pdf in batches:
            for _, texts in portions(pdf["text"], TEXTS):
                h, bounds = token_hashes(texts)
                ids, _, logs = trie.words.look_up(h)
                score, context = trie.walk(ids, logs, bounds)
                at = np.flatnonzero(context >= 0)
                if len(at):
                    held.add(context[at].astype(np.uint64), ids[at].astype(np.uint64), quantise(score[at]))
                if held.size > SEND:
                    yield send()
                    held = Grams()
        yield send()

    return run


def _build_grams(folder: str, cuts: np.ndarray, discount: float):
    def run(batches):
        current, held = None, None

        def finish():
            parent, word, low, counts = held.merge()
            n = int(cuts[current + 1] - cuts[current])
            parent, word = parent.astype(np.int64), word.astype(np.int64)
            pointers = np.concatenate(([0], np.cumsum(np.bincount(parent, minlength=n))))
            seen = np.bincount(parent, counts, n)
            kinds = np.diff(pointers)
            weight = np.divide(discount * kinds, seen, out=np.ones(n), where=seen > 0)
            # raised so that each parent's successors follow those of the parent before
            lasts = np.where(kinds > 0, word[np.maximum(pointers[1:] - 1, 0)] + 1, 0)
            base = np.cumsum(lasts) - lasts
            p = (counts - discount) / seen[parent] + weight[parent] * 10.0 ** restore(low)
            raised = EliasFano.build((word + 1 + base[parent]).astype(np.uint64))
            pointers = EliasFano.build(pointers.astype(np.uint64))
            name = _store(folder, [*pointers.parts, *raised.parts, quantise(np.log10(p)), quantise(np.log10(weight))], sizes=[pointers.n, pointers.low_bits, raised.n, raised.low_bits])
            return pd.DataFrame([(current, name, len(word))], columns=["shard", "file", "n"])

        for (shard,), part in runs(batches, ["shard"]):
            if shard != current:
                if current is not None:
                    yield finish()
                current, held = int(shard), Grams()
            for n, p, k, w, low, c in zip(*(part[x] for x in ("n", "parents", "lengths", "words", "low", "counts")), strict=True):
                lengths = np.frombuffer(k, np.uint32)
                held.add(np.repeat(_widen(p, len(lengths)), lengths), _widen(w, n), np.frombuffer(low, np.uint16), np.frombuffer(c, np.uint8 if len(c) == n else np.int64).astype(np.int64))
        if current is not None:
            yield finish()

    return run


class Level:
    """The n-grams of one order: successors of the nodes of the level above, which ``cuts`` divides into shards."""

    def __init__(self, folder: str, cuts: np.ndarray, table: list[tuple[int, str, int]]):
        self.folder, self.cuts = folder, cuts
        self.files = {s: f for s, f, _ in table}
        size = np.zeros(len(cuts), np.int64)
        for s, _, n in table:
            size[s + 1] = n
        self.base = np.cumsum(size)
        self.n = int(self.base[-1])

    def look_up(self, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, log10 p, log10 weight of the parent); node -1 if there is none; words may be -1."""
        a, b = parents.astype(np.uint64), (words + 1).astype(np.uint64)
        order, first = ordered(a, b)
        number = np.zeros(len(order), np.int64)
        number[first[1:]] = 1
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(number)
        u, v = parents[order[first]], words[order[first]]
        node, p, weight = np.full(len(u), -1, np.int64), np.zeros(len(u)), np.zeros(len(u))
        cut = np.searchsorted(u, self.cuts)
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if s in self.files:
                x = slice(cut[s], cut[s + 1])
                node[x], p[x], weight[x] = self._in_shard(s, u[x] - self.cuts[s], v[x])
        return node[inverse], p[inverse], weight[inverse]

    def _in_shard(self, s: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        about, parts = _fetch(self.folder, self.files[s])
        n1, b1, n2, b2 = about["sizes"]
        pointers, successors, probs, weights = EliasFano(n1, b1, *parts[0:4]), EliasFano(n2, b2, *parts[4:8]), parts[8], parts[9]
        starts = np.flatnonzero(np.diff(u, prepend=-1))
        own, repeat = u[starts], np.diff(starts, append=len(u))
        begin, end = (x.astype(np.int64) for x in pointers.get_pairs(own))
        base = np.zeros(len(own), np.uint64)
        base[begin > 0] = successors.get(begin[begin > 0] - 1)
        begin, end, base = (np.repeat(x, repeat) for x in (begin, end, base))
        at = np.full(len(u), -1, np.int64)
        asked = np.flatnonzero((v >= 0) & (end > begin))
        at[asked] = successors.find(base[asked] + (v[asked] + 1).astype(np.uint64))
        hit = (at >= begin) & (at < end)
        node, p = np.full(len(u), -1, np.int64), np.zeros(len(u))
        node[hit], p[hit] = self.base[s] + at[hit], restore(probs[at[hit]])
        return node, p, np.repeat(restore(weights[own]), repeat)


class Trie:
    """All levels; answers log10 p(w | h) for the tokens of texts."""

    def __init__(self, words: Words, levels: list[Level]):
        self.words, self.levels = words, levels

    @property
    def parents(self) -> int:
        """Nodes that a further level could have as parents."""
        return self.levels[-1].n if self.levels else self.words.n + 1

    def walk(self, ids: np.ndarray, logs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 p, parent in a further level) of each token; -1 where the trie has no such context or the text begins within it."""
        score, starts = logs.copy(), bounds[:-1]
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[starts] = self.words.n  # the begin of a text
        for level in self.levels:
            at = np.flatnonzero(context >= 0)
            found, p, weight = level.look_up(context[at], ids[at])
            hit = found >= 0
            score[at] = np.where(hit, p, score[at] + weight)
            node = np.full(len(ids), -1, np.int64)
            node[at] = found
            node[starts] = -1
            context = np.empty_like(ids)
            context[1:] = node[:-1]
            context[starts] = -1
        return score, context


def fit(train: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> Trie:
    """The trie of all texts of ``train(text)``."""
    spark = train.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = train.select(F.col("text").cast("string").alias("text"))
    folder = scratch.folder("trie")
    dealt = lambda df, n: df.repartitionById(n, "shard").sortWithinPartitions("shard")
    counted = dealt(rows.mapInPandas(_count_words(parts), "shard int, keys binary, counts binary"), parts)
    table = scratch.save(counted.mapInPandas(_build_words(folder, parts), "shard int, file string, n long, total long"), "words")
    trie = Trie(Words(folder, [tuple(r) for r in table.limit(parts).collect()], parts), [])
    shards = max(parts, -(-trie.words.total // SHARD))
    for _ in range(order - 1):
        cuts = np.linspace(0, trie.parents, shards + 1).astype(np.int64)
        shared = spark.sparkContext.broadcast(trie)
        grams = dealt(rows.mapInPandas(_count_grams(shared, cuts), _GRAMS), shards)
        built = scratch.save(grams.mapInPandas(_build_grams(folder, cuts, discount), "shard int, file string, n long"), "grams")
        trie = Trie(trie.words, [*trie.levels, Level(folder, cuts, [tuple(r) for r in built.limit(shards).collect()])])
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        t: Trie = shared.value
        for pdf in batches:
            for at, texts in portions(pdf["text"], TEXTS):
                h, bounds = token_hashes(texts)
                ids, counts, logs = t.words.look_up(h)
                p, _ = t.walk(ids, logs, bounds)
                base = np.log10((counts + 1) / (t.words.total + t.words.n + 1))
                first = bounds[:-1]
                out = pdf[["doc_id", "held_out"]].iloc[at : at + len(texts)].copy()
                out["n_tokens"], out["n_known"] = np.diff(bounds), np.add.reduceat((counts > 0).astype(np.int64), first)
                out["train_tokens"] = t.words.total
                out["base_score"], out["score"] = np.add.reduceat(base, first), np.add.reduceat(p, first)
                yield out

    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learns from the documents that aren't held out and scores all."""
    return score(docs, fit(docs.where(~held_out()), order))
