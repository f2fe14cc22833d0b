"""FM-index of one bounded shard of word numbers, over numpy arrays: build, count, locate."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order; its last symbol must be unique.

    Three symbols are sorted at once, then the compared length doubles, but only for suffixes
    that still share a rank.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    if bits > 21:
        text = np.unique(text, return_inverse=True)[1]
        bits = max(1, int(text.max()).bit_length())
    padded = np.concatenate((text.astype(np.int64) + 0, np.zeros(3, dtype=np.int64)))
    depth = 3 if bits <= 21 else 1
    key = padded[:n].copy()
    for i in range(1, depth):
        key = (key << bits) | padded[i : n + i]
    order = np.argsort(key)
    ranked = key[order]
    places = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    while True:
        new = np.ones(len(ranked), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = np.maximum.accumulate(np.where(new, places, 0))
        rank[order[places]] = first
        alone = new.copy()
        alone[:-1] &= new[1:]
        places = places[~alone]
        if not len(places):
            return order
        tied = order[places]
        further = np.minimum(tied + depth, n - 1)  # tied suffixes never reach past the unique last symbol
        key = (rank[tied] << 32) | rank[further]
        by = np.argsort(key)
        order[places] = tied[by]
        ranked = key[by]
        depth *= 2


class BitRank:
    """Ones before a position of a bit sequence: a count per 64 bits and the bits themselves."""

    def __init__(self, bits: np.ndarray):
        size = (len(bits) // 64 + 1) * 64
        padded = np.zeros(size, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank and access over a large alphabet: one bit sequence per bit of the symbols, high bit first."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, BitRank, int]] = []
        current = symbols.astype(np.int32)
        for shift in reversed(range(max(1, int(symbols.max()).bit_length()))):
            ones = (current >> shift & 1).astype(bool)
            self.levels.append((shift, BitRank(ones), int(len(ones) - ones.sum())))
            current = np.concatenate((current[~ones], current[ones]))

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` lands for ``symbol``; minus the landing of 0 it is the symbol's rank at ``i``."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``i`` and where these positions land."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.ones(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


class FmIndex:
    """Counts and locates phrases in ``text``; every ``rate``-th position of the text is sampled."""

    def __init__(self, text: np.ndarray, rate: int = 8):
        order = suffix_array(text)
        self.size = len(text)
        self.tree = WaveletMatrix(text[order - 1])  # position -1 is the last symbol: a round trip
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        sampled = order % rate == 0
        self.sampled, self.samples = BitRank(sampled), order[sampled]

    def _rank_base(self, symbol: np.ndarray) -> np.ndarray:
        return self.before[symbol] - self.tree.follow(symbol, np.zeros_like(symbol))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that start with each phrase (rows of ``phrases``, right-aligned), by backward search."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        width = phrases.shape[1]
        for step in range(1, width + 1):
            live = np.nonzero((lengths >= step) & (low < high))[0]
            if not len(live):
                break
            symbol = phrases[live, width - step]
            base = self._rank_base(symbol)
            low[live] = base + self.tree.follow(symbol, low[live])
            high[live] = base + self.tree.follow(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one, count the steps."""
        found = np.zeros(len(rows), dtype=np.int64)
        left, rows, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.sampled.get(rows)
            found[left[hit]] = self.samples[self.sampled.ones(rows[hit])] + steps
            left, rows = left[~hit], rows[~hit]
            if len(left):
                symbol, place = self.tree.read(rows)
                rows = self._rank_base(symbol) + place
            steps += 1
        return found
