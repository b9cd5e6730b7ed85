"""FM-index over runs of token ids: wavelet ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, packed in 64-bit words with counts before each word."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            zeros = int(len(bits) - bits.sum())
            self.levels.append((words, before, zeros))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    @staticmethod
    def ones(level: tuple[np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        words, before, _ = level
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(at)
        for k, level in enumerate(self.levels):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            ones_at, ones_start = self.ones(level, at), self.ones(level, start)
            at = np.where(one, level[2] + ones_at, at - ones_at)
            start = np.where(one, level[2] + ones_start, start - ones_start)
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in self.levels:
            bit = ((level[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self.ones(level, at)
            out = out * 2 + bit
            at = np.where(bit == 1, level[2] + ones, at - ones)
        return out


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; the last value must occur once. Ranks double in length for the tied only."""
    n = len(values)
    width = int(values.max()) + 1
    span = 3 if width < 1 << 21 else 2
    padded = np.concatenate((values, np.zeros(span, np.int64)))
    key = padded[:n].copy()
    for k in range(1, span):
        key = key * width + padded[k : n + k]
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    row = np.arange(n)
    first = np.maximum.accumulate(np.where(new, row, 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    last = np.concatenate((new[1:], [True]))
    rows = row[~(new & last)]
    while len(rows):
        at = order[rows]
        follow = np.where(at + span < n, rank[np.minimum(at + span, n - 1)], -1)
        by = np.lexsort((follow, rank[at]))
        at, follow = at[by], follow[by]
        order[rows] = at
        group = rank[at]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        last = np.concatenate((new[1:], [True]))
        rows = rows[~(new & last)]
        span *= 2
    return order


class FMIndex:
    """An index over tokens from 1 to sigma - 1, where 0 separates runs; patterns hold no 0.

    Separators count as different from each other, so that suffixes differ within their run. Suffix positions are kept
    at every run's start and at every `sample`-th position.
    """

    def __init__(self, tokens: np.ndarray, sigma: int, sample: int = 8):
        tokens = np.concatenate((tokens, [0])).astype(np.int64)
        breaks = tokens == 0
        values = np.where(breaks, np.cumsum(breaks) - 1, tokens + int(breaks.sum()) - 1)
        order = suffix_order(values)
        before = tokens[order - 1]
        self.size = len(tokens)
        self.wavelet = WaveletMatrix(before, sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=sigma))))
        kept = (order % sample == 0) | (before == 0)
        self.kept_rank = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that start with each pattern: (from, to). patterns: ids padded at the end."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.nonzero((lengths >= back) & (low < high))[0]
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back]
            low[live] = self.less[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: steps back until a kept one is met."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            kept = self.kept_rank[at + 1] > self.kept_rank[at]
            out[todo[kept]] = self.positions[self.kept_rank[at[kept]]] + steps[todo[kept]]
            todo, at = todo[~kept], at[~kept]
            symbol = self.wavelet.symbol(at)
            at = self.less[symbol] + self.wavelet.rank(symbol, at)
            steps[todo] += 1
        return out
