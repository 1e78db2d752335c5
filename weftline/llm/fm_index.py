"""FM-index over sequences of small integers: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(c, i): how often c occurs among the first i values; vectorised over c and i."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), max(1, bits)
        self.words, self.sums, self.zeros = [], [], []
        v = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (v >> level & 1).astype(np.uint8)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            words = packed.view("<u8")
            self.words.append(words)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(self.n - int(bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w, k = i >> 6, (i & 63).astype(np.uint64)
        return self.sums[level][w] + np.bitwise_count(self.words[level][w] & ((np.uint64(1) << k) - np.uint64(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for level in range(self.bits):
            one = (c >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo = np.where(one, self.zeros[level] + a, lo - a)
            hi = np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes whose rank is still shared are sorted again."""
    n = len(keys)
    _, rank = np.unique(keys, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
    size = np.diff(np.append(start, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)  # a rank is the first place of its group
    open_ = np.repeat(size > 1, size)
    h = 1
    while open_.any():
        at = np.flatnonzero(open_)
        sfx = order[at]
        nxt = sfx + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        first = rank[sfx]
        by = np.lexsort((second, first))
        sfx, first, second = sfx[by], first[by], second[by]
        order[at] = sfx
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        rank[sfx] = np.repeat(at[begin], count)
        open_[at] = np.repeat(count > 1, count)
        h *= 2
    return order


class FMIndex:
    """Index of runs of symbols from 1 to top; 0 in `symbols` ends a run, and no pattern may contain it.

    Each end mark sorts as a symbol of its own, so suffixes differ within their run. Positions of suffixes are kept
    for the first of a run and every `sample`-th after it, so locating takes at most `sample` steps and never passes
    an end mark.
    """

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 8):
        symbols = symbols.astype(np.int64)
        n = self.n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        keys = symbols + len(ends)
        keys[ends] = np.arange(len(ends))
        self.order_positions = None
        order = suffix_order(keys) if n else np.zeros(0, np.int64)
        bwt = symbols[order - 1] if n else symbols  # the one before position 0 is the last, an end mark
        self.bwt = bwt
        self.wavelet = WaveletMatrix(bwt, int(top).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        run = np.zeros(n, np.int64)
        begin = np.concatenate([[0], ends + 1])
        begin = begin[begin < n]
        run[begin] = begin
        run = np.maximum.accumulate(run)
        kept = (np.arange(n) - run) % sample == 0
        self.sampled = kept[order]
        self.slot = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges (from, to) of patterns of one length, a row each; backward search, all patterns in step."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k].astype(np.int64)
            lo, hi = self.before[c] + self.wavelet.rank(c, lo), self.before[c] + self.wavelet.rank(c, hi)
        return lo, np.maximum(hi, lo)

    def locate(self, lo: np.ndarray, hi: np.ndarray, step: int = 1 << 20):
        """Yield (pattern numbers, positions) of all occurrences, in blocks of about `step`."""
        total = np.cumsum(hi - lo)
        a = 0
        while a < len(lo):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + step, side="right")))
            size = hi[a:b] - lo[a:b]
            who = np.repeat(np.arange(a, b), size)
            row = np.repeat(lo[a:b] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            away = np.zeros(len(row), np.int64)
            todo = np.flatnonzero(~self.sampled[row]) if len(row) else np.zeros(0, np.int64)
            while len(todo):
                c = self.bwt[row[todo]]
                row[todo] = self.before[c] + self.wavelet.rank(c, row[todo])
                away[todo] += 1
                todo = todo[~self.sampled[row[todo]]]
            yield who, self.position[self.slot[row]] + away
            a = b
