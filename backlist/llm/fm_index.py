"""A compressed FM-index over weighted word sequences, searched in bulk.

The sequences are joined by separators; suffixes are sorted by their first
``DEPTH`` words, which is all that backward search over patterns of at most
``DEPTH`` words depends on.  The Burrows-Wheeler transform is kept as a
wavelet matrix: one rank-indexed bit vector per bit of the word numbers.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class Bits:
    """A bit vector with constant-time rank: 1.5 bits per bit."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int) -> None:
        """``symbols`` are in ``range(size)``."""
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            one = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(one), int(len(one) - np.count_nonzero(one))))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.base = self._down(np.arange(size), np.zeros(size, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._down(symbol, at) - self.base[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes sorted by their first ``DEPTH`` symbols, by prefix doubling."""
    n, rank, width = len(text), text.astype(np.int64), 1
    while True:
        key = rank << 32
        key[:max(n - width, 0)] |= rank[width:] + 1
        order = np.argsort(key)
        width *= 2
        if width >= DEPTH:
            return order
        step = np.zeros(n, dtype=np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)


class FMIndex:
    """Index of word sequences: ``words`` holds the word numbers (from 1) of
    all sequences, each followed by 0; ``weight`` is how often the sequence
    that each place belongs to occurs."""

    def __init__(self, words: np.ndarray, weight: np.ndarray) -> None:
        self.text = words
        order = suffix_order(words)
        size = int(words.max()) + 1
        self.bwt = WaveletMatrix(words[order - 1], size)
        count = np.bincount(words, minlength=size)
        self.first = np.cumsum(count) - count
        self.weight = np.append(0, np.cumsum(weight[order]))

    def matching_statistics(self, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each place ``end`` of the text: length of the longest run of
        words that ends there, at most ``limit``, and that occurs at least
        twice, by weight."""
        length = np.zeros(len(end), dtype=np.int64)
        at, lo, hi = np.arange(len(end)), np.zeros(len(end), np.int64), np.full(len(end), len(self.text), np.int64)
        at = at[limit > 0]
        lo, hi = lo[at], hi[at]
        while len(at):
            c = self.text[end[at] - length[at]]
            both = self.first[np.tile(c, 2)] + self.bwt.rank(np.tile(c, 2), np.concatenate([lo, hi]))
            lo, hi = both[:len(at)], both[len(at):]
            twice = self.weight[hi] - self.weight[lo] >= 2
            at, lo, hi = at[twice], lo[twice], hi[twice]
            length[at] += 1
            more = length[at] < limit[at]
            at, lo, hi = at[more], lo[more], hi[more]
        return length
