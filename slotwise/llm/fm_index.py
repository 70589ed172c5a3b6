"""FM-index of a symbol sequence: suffix array, wavelet-tree ranks, backward search, sampled positions. All vectorised."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.ones(n, bool)
    head[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = 1
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        at = order[tied]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[at]
        again = np.lexsort((second, first))
        at, first, second = at[again], first[again], second[again]
        order[tied] = at
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        head[tied] = fresh
        rank[at] = tied[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        step *= 2


class WaveletTree:
    """Rank and access over symbols below ``size``: one bit level per binary digit, zeros moved before ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.zeros_before, self.zeros = [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            one = ((current >> level) & 1).astype(bool)
            before = np.zeros(len(current) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros_before.append(before)
            self.zeros.append(int(before[-1]))
            current = np.concatenate([current[~one], current[one]])
        every = np.arange(size)
        self.first = self._descend(every, np.zeros(size, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            zero = self.zeros_before[i][at]
            at = np.where((symbol >> level) & 1, self.zeros[i] + at - zero, zero)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before place ``at``."""
        return self._descend(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for i in range(self.levels):
            before = self.zeros_before[i]
            zero = before[at]
            one = before[at + 1] == zero
            symbol = symbol * 2 + one
            at = np.where(one, self.zeros[i] + at - zero, zero)
        return symbol


class FMIndex:
    """Index of ``symbols`` (all at least 1, below ``size``); 0 is the end mark."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = 16):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.sample = sample
        self.wavelet = WaveletTree(text[order - 1], size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[:size]
        self.marked = order % sample == 0
        self.mark_rank = np.cumsum(self.marked)
        self.samples = order[self.marked]
        self.rows = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of every pattern (rows of ``patterns``, left-aligned) by backward steps, all patterns at once."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.rows, np.int64)
        for t in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > t) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - t]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: walk to the left until a sampled row."""
        found, steps = np.zeros(len(rows), np.int64), 0
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            hit = self.marked[rows]
            found[live[hit]] = self.samples[self.mark_rank[rows[hit]] - 1] + steps
            live, rows = live[~hit], rows[~hit]
            if len(live):
                symbol = self.wavelet.access(rows)
                rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
                steps += 1
        return found
