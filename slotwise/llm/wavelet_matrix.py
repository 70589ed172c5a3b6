"""Wavelet matrix over small symbols: packed bit levels with block counts, ranks, and selection by bisection on ranks."""

from __future__ import annotations

import numpy as np

_ONE, _SIX, _LOW = np.uint64(1), np.uint64(6), np.uint64(63)


class Bits:
    """Bit sequence in 64-bit words with the number of ones before every word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before place ``at``."""
        word = at >> 6
        mask = (_ONE << (at.astype(np.uint64) & _LOW)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """One bit level per binary digit, the highest first; each level puts its zeros before its ones.

    A level takes a bit a symbol and one count per 64 symbols.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        self.length = len(symbols)
        self.shifts = list(range(max(1, int(size - 1).bit_length()) - 1, -1, -1))
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            one = (symbols >> shift) & 1
            self.levels.append(Bits(one))
            self.zeros.append(self.length - int(one.sum()))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place of ``at``."""
        first, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for shift, bits, zeros in zip(self.shifts, self.levels, self.zeros):
            if symbol >> shift & 1:
                first, at = zeros + bits.ones(first), zeros + bits.ones(at)
            else:
                first, at = first - bits.ones(first), at - bits.ones(at)
        return at - first

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many places before ``at`` hold one of ``symbols``: the sum of their ranks."""
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), np.int64))

    def select(self, symbols: tuple[int, ...], nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the ``nth`` (from 0, over the whole sequence) of ``symbols``, which lies in [low, high); high if it doesn't.

        Bisection on ranks: the last place with at most ``nth`` of them before it.
        """
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            reached = self.count(symbols, middle + 1) > nth[live]
            high[live[reached]] = middle[reached]
            low[live[~reached]] = middle[~reached] + 1
            live = live[low[live] < high[live]]
        return low
