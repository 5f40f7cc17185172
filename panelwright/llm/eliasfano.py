"""Elias-Fano coding of monotone sequences, with array-at-a-time access and successor search.

A sequence of n values below u keeps the low l = log2(u / n) bits of each value packed, and the high bits
in unary: value i sets bit high(i) + i of a bit vector. Two small directories of ones and zeros per 64-bit
word serve select. All parts are plain arrays in one buffer, so a file of it can be memory-mapped.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SELECT = np.zeros((256, 8), np.uint8)  # place of the k-th set bit of a byte
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i
_BYTES, _HIGH = _U(0x0101010101010101), _U(0x8080808080808080)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word, by the sums of the bits of its bytes, all in one word."""
    x = words - ((words >> _U(1)) & _U(0x5555555555555555))
    x = (x & _U(0x3333333333333333)) + ((x >> _U(2)) & _U(0x3333333333333333))
    sums = ((x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES  # byte i: the bits of bytes 0 to i
    k = k.astype(np.uint64)
    byte = np.bitwise_count(((k * _BYTES | _HIGH) - sums) & _HIGH).astype(np.uint64) << _U(3)
    rest = k - ((sums << _U(8)) >> byte & _U(0xFF))
    return (byte + _SELECT[(words >> byte & _U(0xFF)).astype(np.int64), rest.astype(np.int64)]).astype(np.int64)


def _next_bit(words: np.ndarray, counts: np.ndarray, place: np.ndarray, flip: bool) -> np.ndarray:
    """The next set (with ``flip``: unset) bit after each place; 64 times the number of words if there is none.

    ``counts``: how many such bits precede each word. A run without any, such as the pointers past a parent of many
    successors, is passed by one search in it, however long it is.
    """
    at = place + 1
    word = at >> 6
    inside = word < len(words)
    rest = words[np.minimum(word, len(words) - 1)]
    rest = (~rest if flip else rest) & (~_U(0) << (at & 63).astype(np.uint64))
    out = np.where(inside, 64 * word + np.bitwise_count((rest & (~rest + _U(1))) - _U(1)), 64 * len(words))
    far = np.flatnonzero((rest == 0) & inside)  # most have one in the same word
    if len(far):
        word = np.searchsorted(counts, counts[word[far] + 1], side="right") - 1
        hit = word < len(words)
        out[far[~hit]] = 64 * len(words)
        far, word = far[hit], word[hit]
        bits = ~words[word] if flip else words[word]
        out[far] = 64 * word + np.bitwise_count((bits & (~bits + _U(1))) - _U(1))
    return out


class EliasFano:
    """Built by ``EliasFano.build``; ``parts`` are its arrays, for storage."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros
        # a word from every byte on: one of them holds a field of up to 57 bits
        self._from = np.ndarray((8 * len(low) - 7,), "<u8", np.ascontiguousarray(low), strides=(1,))

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """``values``: uint64, not decreasing."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = values & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            # a field may reach into the next word; fields of a word are disjoint, so sums are unions
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[starts]] += np.add.reduceat(part << shift, starts)
            over = np.flatnonzero(shift + _U(bits) > 64)
            low[word[over] + 1] += part[over] >> (_U(64) - shift[over])
        places = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) if n else 0) // 64 + 2
        high = np.zeros(size, np.uint64)
        if n:
            word = places >> 6
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            high[word[starts]] = np.bitwise_or.reduceat(_U(1) << (places & 63).astype(np.uint64), starts)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        zeros = 64 * np.arange(size + 1, dtype=np.int64) - ones
        kind = np.uint32 if 64 * (size + 1) < 1 << 32 else np.int64
        return cls(n, bits, low, high, ones.astype(kind), zeros.astype(kind))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        if self.low_bits <= 57:
            at = i * self.low_bits
            return (self._from[at >> 3] >> (at & 7).astype(np.uint64)) & _U((1 << self.low_bits) - 1)
        at = i.astype(np.uint64) * _U(self.low_bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (first | second) & _U((1 << self.low_bits) - 1)

    def _select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k.astype(self.ones.dtype), side="right") - 1
        return 64 * word + _select_in_word(self.high[word], k - self.ones[word].astype(np.int64))

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        inside = k - self.zeros[word].astype(np.int64)
        past = inside >= 64  # beyond the last stored zero
        return np.where(past, 64 * len(self.high), 64 * word + _select_in_word(~self.high[word], np.where(past, 0, inside)))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select1(i) - i).astype(np.uint64)
        return (high << _U(self.low_bits)) | self._lows(i)

    def get_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places i and i + 1."""
        if not len(i):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        place = self._select1(i)
        after = _next_bit(self.high, self.ones, place, False)
        bits = _U(self.low_bits)
        return ((place - i).astype(np.uint64) << bits) | self._lows(i), ((after - i - 1).astype(np.uint64) << bits) | self._lows(i + 1)

    def _bucket(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, end) of the values with the high part of x, and whether x is beyond all of them."""
        h = (x >> _U(self.low_bits)).astype(np.int64)
        most = int(self.zeros[-1]) - 1
        beyond = h > most
        h = np.minimum(h, most)
        # values with high part h lie between the h-th and the (h+1)-th zero
        zero = np.where(h > 0, self._select0(np.maximum(h - 1, 0)), -1)
        end = _next_bit(self.high, self.zeros, zero, True) - h
        return np.minimum(zero + 1 - h, self.n), np.minimum(end, self.n), beyond

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first value of the bucket that is not below x, the bucket's end, whether x is beyond all)."""
        at, end, beyond = self._bucket(x)
        want, stop = x & _U((1 << self.low_bits) - 1), end.copy()
        while len(live := np.flatnonzero(at < stop)):  # binary search among equal high parts
            mid = (at[live] + stop[live]) // 2
            less = self._lows(mid) < want[live]
            at[live] = np.where(less, mid + 1, at[live])
            stop[live] = np.where(less, stop[live], mid)
        return at, end, beyond

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value not below x (n if there is none)."""
        if not len(x) or not self.n:
            return np.full(len(x), self.n, np.int64)
        at, _, beyond = self._search(x)
        return np.where(beyond, self.n, at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the successor of x where it is x itself, else -1."""
        if not len(x) or not self.n:
            return np.full(len(x), -1, np.int64)
        at, end, beyond = self._search(x)
        inside = np.flatnonzero((at < end) & ~beyond)
        same = self._lows(at[inside]) == x[inside] & _U((1 << self.low_bits) - 1)
        out = np.full(len(x), -1, np.int64)
        out[inside[same]] = at[inside[same]]
        return out
