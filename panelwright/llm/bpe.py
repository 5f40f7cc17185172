"""BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest vocabulary entries. Such a cut is the BPE encoding if and
only if every adjacent pair of its tokens is one that BPE itself leaves side by side; the pairs of all
new words of a batch are tested together with array operations. Words with a failing pair, and only
those, are merged exactly, merge by merge.

The compatibility test undoes the merges that made the two tokens, latest first, and looks whether the
two pieces that then touch would have been merged before the piece undone last came to be.

Texts are split into words as the vocabulary file says: where its normaliser and splitter are those written
out below, texts of Latin letters are split here, all others by the library. A file whose model has parts
that this codec has not (unknown tokens, byte fallback, prefixes, special tokens with own rules, no byte-level
splitter) is refused. Words are remembered with their tokens, up to
``MEMO`` of them per Python worker; beyond that the memory is emptied.

Edge cases: null and empty texts have no tokens and decode to an empty text; special tokens' strings
inside a text become their ids, as the library does it; very long texts are encoded whole; repeated rows
are encoded each. Columns other than those named are passed over; kept columns named ``ids`` or ``decoded``
give way to the results.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered per Python worker.
MEMO = 150_000
_NONE, _MASK = 1 << 60, (1 << 24) - 1
_END = ""  # stands for the end-of-word suffix; byte-level words never hold it
#: Characters whose split can be done here exactly: Latin letters, digits, punctuation, plain white space.
_PLAIN = re.compile("[\t\n\r\x0b\x0c -~\xa0-įı-ɏ]*").fullmatch
#: The vocabulary file's split pattern (a fixed value), for those characters: \p{N} are these digits, \p{L} the other word characters.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:[^\\s\\w]|_)+").findall


# The normaliser and splitter of the vocabulary file that _WORDS restates.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def check(spec: dict) -> None:
    """Raises if the file needs something that this codec does not do."""
    model, splitter = spec["model"], json.dumps(spec.get("pre_tokenizer"))
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [f"special token {t['content']}" for t in spec["added_tokens"] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    odd += ["post_processor"] if spec.get("post_processor") and spec["post_processor"].get("type") != "ByteLevel" else []
    if model.get("type") != "BPE" or "ByteLevel" not in splitter or '"add_prefix_space": true' in splitter or odd:
        raise ValueError(f"not a byte-level BPE vocabulary that can be encoded here: {', '.join(odd) or 'model or splitter'}")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class SpeculativeBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        check(spec)
        self._latin = spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _SPLITTER
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self._tail = _END if suffix else ""
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self._specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

        def own(t: str) -> str:
            return t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t

        size = max(self.text_of) + 1
        vocab = {own(t): i for t, i in model["vocab"].items()}
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[own(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            to = vocab[own(self._joined(pair, suffix))]
            self.merges[a, b] = rank, to
            if self.rank[to] < 0:
                self.left[to], self.right[to], self.rank[to] = a, b, rank
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self._size, self._keys, self._ranks = size, keys[order], ranks[order]
        self.vocab = vocab
        self._packed = {pair: rank << 24 | to for pair, (rank, to) in self.merges.items()}
        # entries that BPE itself never makes from their own text are of no use as a proposal
        self.greedy = {t: i for t, i in vocab.items() if len(t) == 1 or (len(t) == 2 and t[1] == _END) or self.rank[i] >= 0 and self.merge(t) == [i]}
        longest: dict[str, int] = {}
        for t in self.greedy:
            longest[t[:2]] = max(longest.get(t[:2], 0), len(t))
        self._longest = longest
        self._texts = [self.text_of.get(i, "") for i in range(size)]
        self._bytes = byte_symbols()
        self._forget()

    @staticmethod
    def _joined(pair, suffix: str) -> str:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        return a + b

    # ------------------------------------------------------------ words

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self._offsets, self._lengths, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, word: str) -> list[int]:
        """Exact BPE: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
        pieces = [*word[:-2], word[-2:]] if word.endswith(_END) else word
        ids = [self.vocab[c] for c in pieces]
        if len(ids) > 64:
            return self._merge_long(ids)
        find = self._packed.get
        ranks = [find(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            ids[i : i + 2] = [least & _MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), _NONE)
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked pieces, for words of any length."""
        find = self._packed.get
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := find(p, _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or find((ids[i], ids[j]), _NONE) != r:
                continue
            ids[i], ids[j] = r & _MASK, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := find((ids[i], ids[after[i]]), _NONE)) < _NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := find((ids[before[i]], ids[i]), _NONE)) < _NONE:
                heapq.heappush(heap, (r, before[i]))
        return [i for i in ids if i >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over the word with its end mark."""
        out, at, n, find, longest = [], 0, len(word), self.greedy.get, self._longest
        while at < n:
            end = min(n, at + longest.get(word[at : at + 2], 1))
            while (i := find(word[at:end])) is None:
                end -= 1
            if self._tail and end == n - 1:  # the end mark can't stand alone: leave a character to it
                end -= 1
                while end > at and (i := find(word[at:end])) is None:
                    end -= 1
                if end <= at:
                    return []
            out.append(i)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves tokens a and b side by side, for arrays of pairs."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), np.iinfo(np.int64).max)
        rank, left, right = self.rank, self.left, self.right
        while len(live):
            key = a * self._size + b
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            met = np.where(self._keys[at] == key, self._ranks[at], np.iinfo(np.int64).max)
            bad = met < limit
            good[live[bad]] = False
            ra, rb = rank[a], rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            undo_a = ra > rb  # of two equal merges BPE does the left one first, so the right one is undone first
            # a merge across the gap stands left of b's own, so it also wins at equal rank; right of a's own it does not
            limit = np.where(undo_a, ra, rb + 1)[go]
            a, b, live = np.where(undo_a, right[a], a)[go], np.where(undo_a, b, left[b])[go], live[go]
        return good

    def _learn(self, words: list[str]) -> None:
        """Encode new chunks, each a list of byte-level words joined by blanks."""
        number: dict[str, int] = {}
        used = [number.setdefault(w, len(number)) for chunk in words if chunk for w in chunk.split(" ")]
        owned = np.fromiter((chunk.count(" ") + 1 if chunk else 0 for chunk in words), np.int64, len(words))
        parts = [w + self._tail for w in number]
        proposals = list(map(self.propose, parts))
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        inner = np.ones(len(flat), bool)
        inner[ends[lengths > 0] - 1] = False
        at = np.flatnonzero(inner)
        wrong = lengths == 0
        if len(at):
            pairs, inv = np.unique(flat[at] * self._size + flat[at + 1], return_inverse=True)
            ok = self.compatible(pairs // self._size, pairs % self._size)[inv]
            wrong[np.searchsorted(ends, at[~ok], side="right")] = True
        for k in np.flatnonzero(wrong).tolist():
            proposals[k] = self.merge(parts[k])
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int32, int(lengths.sum()))
        use = np.array(used, np.int64)
        counts, starts = lengths[use], (np.cumsum(lengths) - lengths)[use]
        ends = np.cumsum(counts)
        spread = flat[np.arange(counts.sum()) + np.repeat(starts - ends + counts, counts)]
        self._add(np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(owned)))]), spread)

    def _add(self, counts: np.ndarray, flat: np.ndarray) -> None:
        first = len(self._flat)
        self._offsets = np.concatenate((self._offsets, first + np.cumsum(counts) - counts))
        self._lengths = np.concatenate((self._lengths, counts))
        self._flat = np.concatenate((self._flat, flat))

    def _byte_level(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self._bytes.__getitem__, word.encode()))

    def _chunks(self, text: str) -> list:
        """Memo keys of a text: plain chunks between white space, ready-split chunks, special ids."""
        out: list = []
        at = 0
        for m in [*(self._specials.finditer(text) if self._specials else ()), None]:
            piece = text[at : m.start() if m else len(text)]
            if self._latin and _PLAIN(piece):
                out += piece.lower().split()
            elif piece:
                normal = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
                out += [("w", w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            if m:
                out.append(("s", self.special[m.group()]))
                at = m.end()
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
        if len(self.memo) > MEMO:
            self._forget()
        memo, new, numbers, sizes = self.memo, [], [], []
        for text in texts:
            before = len(numbers)
            for c in self._chunks(text or ""):
                n = memo.get(c)
                if n is None:
                    n = memo[c] = len(memo)
                    new.append(c)
                numbers.append(n)
            sizes.append(len(numbers) - before)
        if new:
            self._waiting(new)
        at = np.array(numbers, np.int64)
        counts = self._lengths[at]
        ends = np.cumsum(counts)
        ids = self._flat[np.arange(counts.sum()) + np.repeat(self._offsets[at] - ends + counts, counts)]
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64)]

    def _waiting(self, new: list) -> None:
        words = []
        specials = {}
        for k, c in enumerate(new):
            if isinstance(c, str):
                words.append(" ".join(map(self._byte_level, _WORDS(c))))
            elif c[0] == "w":
                words.append(c[1])
            else:
                specials[k] = c[1]
                words.append("")
        first = len(self._offsets)
        self._learn(words)
        for k, i in specials.items():
            self._offsets[first + k], self._lengths[first + k] = len(self._flat), 1
            self._flat = np.append(self._flat, np.int32(i))

    def decode(self, ids) -> str:
        """The tokens' texts joined by blanks where the vocabulary file names no decoder, else as the library decodes."""
        if self.library.decoder is not None:
            return self.library.decode(list(ids), skip_special_tokens=False)
        return " ".join(map(self._texts.__getitem__, ids))


_made: dict[str, SpeculativeBpe] = {}


def codec(path: str) -> SpeculativeBpe:
    """One per Python worker and file."""
    if path not in _made:
        _made[path] = SpeculativeBpe(path)
    return _made[path]


#: Characters encoded at once.
_TEXTS = 1 << 20


def _slices(texts: list, limit: int = _TEXTS):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= limit):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns plus ``ids array<int>`` for ``docs.text``, and ``decoded string`` for the ids if asked for."""
    results = ["ids", *(["decoded"] if decoded else [])]
    keep = tuple(c for c in keep if c not in results)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for at, end in _slices(texts):
                ids, bounds = bpe.encode(texts[at:end])
                out = [batch.column(i).slice(at, end - at) for i in range(len(keep))]
                out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                if decoded:
                    out.append(pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*names, *results])

    types = dict(rows.dtypes)
    found = rows.mapInArrow(run, ", ".join([f"{c} {types[c]}" for c in names] + ["ids array<int>"] + ["decoded string"] * decoded))
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *results)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns plus ``decoded string`` for ``ids``; a column of that name gives way to it. Null ids decode to an empty text."""
    keep = [c for c in encoded.columns if c != "decoded"]
    names, at = [f"k{i}" for i in range(len(keep))], keep.index("ids")
    rows = encoded.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            texts = pa.array([bpe.decode(x.as_py() or ()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, "decoded"])

    types = dict(rows.dtypes)
    found = rows.mapInArrow(run, ", ".join([f"{c} {types[c]}" for c in names] + ["decoded string"]))
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "decoded")
