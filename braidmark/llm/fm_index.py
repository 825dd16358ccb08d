"""A compressed full-text index over word numbers: wavelet matrix of the Burrows-Wheeler transform.

Texts end at a separator each (number 0, all of them less than any word and in order of place),
so suffixes compare up to their text's end. Searches run backward, many at a time.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; zeros differ from each other by their place."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """rank(symbol, place) in about log2(symbols) bit ranks; one bit a symbol and level, plus counts each 64."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels, self.n = max(1, int(symbols - 1).bit_length()), len(values)
        self.words, self.counts, self.zeros = [], [], []
        current = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bits = (current >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int64))
            self.zeros.append(self.n - int(bits.sum()))
            current = np.concatenate([current[bits == 0], current[bits == 1]])
        self.base = self._walk(np.arange(symbols, dtype=np.int64), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            at = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[i][at] + np.bitwise_count(self.words[i][at] & below)
            place = np.where((symbol >> level) & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._walk(symbol, place) - self.base[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, weights: np.ndarray):
        """text: numbers from 1, each text followed by 0; weights: how often each text occurs."""
        order = suffix_order(text)
        text_of = np.cumsum(text == 0) - (text == 0)
        self.mass = np.concatenate([[0], np.cumsum(weights[text_of[order]])])
        self.wavelet = WaveletMatrix(text[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.n = len(text)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each match after one more symbol on its left."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        at, m = self.first[symbol], len(symbol)
        return at + both[:m], at + both[m:]


def repeated_windows(text: np.ndarray, starts: np.ndarray, windows: np.ndarray, width: int, symbols: int, weights: np.ndarray) -> np.ndarray:
    """For windows[j] consecutive windows of `width` from starts[j] on: which occur twice or more in text, whose j-th text occurs weights[j] times.

    Returns a mask over text's places. Each pattern holds a range of undecided windows and tries,
    in turn, the whole stretch under them and the leftmost window alone, going back word by word
    while places of a weight of two match (the matching statistics of the stretch's end). Where the match
    of a stretch ends, the windows to the right of that place are repeats; where that of the
    leftmost window ends, no window that covers the unmatched part can be.
    """
    index, hit = FMIndex(text, symbols, weights), np.zeros(len(text) + 1, np.int64)
    low, high = starts.astype(np.int64), (starts + windows - 1).astype(np.int64)
    whole = np.ones(len(low), bool)
    at = high + width - 1
    a, b = np.zeros(len(low), np.int64), np.full(len(low), index.n, np.int64)
    while len(low):
        x, y = index.step(text[at], a, b)
        alive = index.mass[y] - index.mass[x] >= 2
        done = alive & (at == low)
        fail = ~alive
        # a full match: all undecided windows of a stretch, or the one leftmost window
        last = np.where(whole, high, low)
        np.add.at(hit, low[done], 1)
        np.add.at(hit, last[done] + 1, -1)
        # a stretch that fails at `at`: what starts right of it is repeated, and its last window isn't if it covers it
        part = fail & whole & (at + 1 <= high)
        np.add.at(hit, at[part] + 1, 1)
        np.add.at(hit, high[part] + 1, -1)
        new_low = np.where(done, last + 1, np.where(fail & ~whole, at + 1, low))
        new_high = np.where(fail & whole, np.minimum(at, high - 1), high)
        turned = done | fail
        whole = np.where(turned, ~whole, whole)
        low, high = new_low, new_high
        at = np.where(turned, np.where(whole, high, low) + width - 1, at - 1)
        a, b = np.where(turned, 0, x), np.where(turned, index.n, y)
        keep = low <= high
        low, high, whole, at, a, b = (v[keep] for v in (low, high, whole, at, a, b))
    return np.cumsum(hit[:-1]) > 0
