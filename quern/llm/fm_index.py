"""A compressed full-text index over whole numbers: the Burrows-Wheeler transform in a wavelet matrix.

Bits are packed, with one count for every 64 of them. Suffixes are sorted by their first DEPTH symbols only: an
interval of backward search counts the suffixes before a pattern of at most DEPTH symbols, and these do not depend
on how longer ties are broken.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16
_ONE = np.uint64(1)


def depth_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The suffixes of a text by their first `depth` symbols (a power of two), by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    h = 1
    while h < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-h] = rank[h:]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        h *= 2
    return np.argsort(rank, kind="stable")


class Bits:
    """Packed bits with the number of ones before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        held = np.zeros(n * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        held[: len(packed)] = packed
        self.words = held.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))


class Wavelet:
    """How often a symbol comes before a place, level by level of its bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for bit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            one = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, Bits(one)))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        every = np.arange(size)
        self.first = self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> bit) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.first[symbol]


class Index:
    """Symbols from 1 to size - 1; 0 stands between texts and at the end."""

    def __init__(self, text: np.ndarray, size: int):
        self.order = depth_order(text)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.wavelet = Wavelet(text[self.order - 1], size)

    def matches(self, text: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics up to `width` of a text at places, read backwards, and the interval of what was matched last.

        A place stops as its match has one occurrence only. Texts read before their begin meet a 0, which matches nothing
        but the begin of a text, and end there too.
        """
        c = text[ends]
        low, high = self.below[c], self.below[c + 1]
        length = np.ones(len(ends), np.int64)
        on = np.flatnonzero(high - low > 1)
        for k in range(1, width):
            c = text[ends[on] - k]
            low[on] = self.below[c] + self.wavelet.rank(c, low[on])
            high[on] = self.below[c] + self.wavelet.rank(c, high[on])
            length[on] += 1
            on = on[high[on] - low[on] > 1]
        return length, low, high
