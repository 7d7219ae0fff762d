"""FM-index over the word sequences of a shard: suffix array, wavelet matrix, backward search.

Sequences are joined with separators (symbol 0), each has a weight (how often it occurs). The transformed
text is kept as a wavelet matrix: ``log2(symbols)`` bit vectors with counts for every 64 bits. A step of
backward search takes two rank queries per level; all queries of a batch take their steps together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; ``left`` is the distance to the separator that ends each.

    What follows a separator does not count, so suffixes that are equal up to it may stand in any order.
    """
    longest, span = int(left.max()) + 1, 1
    rank = text.astype(np.int64)
    while True:
        tail = np.zeros_like(rank)
        np.copyto(tail[:-span], rank[span:], where=left[:-span] >= span)
        key = rank * (int(rank.max()) + 1) + tail
        order = np.argsort(key)
        key = key[order]
        fresh = np.empty(len(key), np.int64)
        fresh[0] = 0
        np.cumsum(key[1:] != key[:-1], out=fresh[1:])
        span *= 2
        if span >= longest or fresh[-1] == len(key) - 1:
            return order
        rank = np.empty_like(fresh)
        rank[order] = fresh


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(128 - len(bit) % 64, bool)), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int32)
            self.words.append(packed)
            self.counts.append(np.cumsum(ones, dtype=np.int32) - ones)
            self.zeros.append(len(bit) - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` entries equal to ``symbol`` end in the order of the last level."""
        for level, (words, counts, zeros) in enumerate(zip(self.words, self.counts, self.zeros)):
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(words[block] & below)
            up = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            at = np.where(up, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of ``symbols`` (from 1 on), cut into sequences at ``first``, with a weight for each sequence."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, weights: np.ndarray):
        lengths = np.diff(first)
        self.symbols, self.first = symbols, first
        n = len(symbols) + len(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols
        order = suffix_array(text, ends[owner] - np.arange(n))
        size = int(text.max()) + 1
        self.tree = WaveletMatrix(text[order - 1], size)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        every = np.arange(size)
        self.shift = self.begin[:-1] - self.tree.descend(every, np.zeros(size, np.int64))
        self.total = np.concatenate([[0], np.cumsum(weights[owner[order]])])

    def match_back(self, low: np.ndarray, high: np.ndarray, times: int = 2) -> np.ndarray:
        """Matching statistics: least ``q >= low`` such that ``symbols[q:high]`` occurs ``times`` or more."""
        out = high.copy()
        live = np.arange(len(low))
        at = high - 1
        symbol = self.symbols[at]
        a, b = self.begin[symbol], self.begin[symbol + 1]
        while len(live):
            good = self.total[b] - self.total[a] >= times
            live, at, a, b = live[good], at[good], a[good], b[good]
            out[live] = at
            more = at > low[live]
            live, at, a, b = live[more], at[more] - 1, a[more], b[more]
            symbol = self.symbols[at]
            both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([a, b]))
            a, b = both[: len(a)] + self.shift[symbol], both[len(a) :] + self.shift[symbol]
        return out

    def repeated(self, window: int, times: int = 2) -> np.ndarray:
        """Of each symbol, whether the ``window`` symbols from it on lie in its sequence and occur ``times``.

        Ranges of undecided windows are tested from their ends: if ``symbols[q:e]`` is the longest
        repeated text that ends at ``e``, windows from q on are repeated, and those that hold
        ``symbols[q-1:e]`` are not. Ranges that stay open are halved.
        """
        marks = np.zeros(len(self.symbols) + 1, np.int64)
        low, high = self.first[:-1], self.first[1:] - window
        some = high >= low
        low, high = low[some], high[some]
        turn = 0
        while len(low):
            middle = (high, low, (low + high) >> 1)[min(turn, 2)]
            miss = self.match_back(low, middle + window, times) - 1
            good = miss < middle
            np.add.at(marks, np.maximum(miss + 1, low)[good], 1)
            np.add.at(marks, middle[good] + 1, -1)
            low, high = (
                np.concatenate([low, np.where(good, middle, np.minimum(miss, high)) + 1]),
                np.concatenate([np.where(good, np.maximum(miss, low - 1), middle - 1), high]),
            )
            some = low <= high
            low, high = low[some], high[some]
            turn += 1
        return marks[:-1].cumsum() > 0
