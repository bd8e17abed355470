"""FM-index over word sequences: suffix array, BWT in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits packed 64 to a word, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask).astype(np.int64)


class WaveletMatrix:
    """Rank of symbols in a sequence, in one bit plane per bit of the alphabet's size."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.planes: list[tuple[int, BitRank]] = []
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            self.planes.append((bit, BitRank(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(alphabet)
        self.begins = self._down(every, np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, plane in self.planes:
            ones = plane.ones(i)
            i = np.where((symbol >> bit) & 1, plane.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, i) - self.begins[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the symbols must make all suffixes differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        places = np.cumsum(new) - 1
        rank = np.empty(n, np.int64)
        rank[order] = places
        if n == 0 or places[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index over segments of word numbers (from 0); each segment has an owner.

    Every segment ends in a mark of its own, smaller than all words, so no match runs over
    a segment's end. ``step`` extends matches to the left; ``least_owner`` is the smallest
    owner among the occurrences of a match.
    """

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, owners: np.ndarray):
        m = len(bounds) - 1
        lengths = np.diff(bounds)
        n = len(flat) + m
        segment = np.repeat(np.arange(m), lengths + 1)
        text = np.empty(n, np.int64)
        ends = np.cumsum(lengths + 1) - 1
        is_mark = np.zeros(n, bool)
        is_mark[ends] = True
        text[is_mark], text[~is_mark] = np.arange(m), flat + m
        order = suffix_array(text)
        words = np.where(is_mark, 0, text - m + 1)
        self.size, alphabet = n, int(words.max(initial=0)) + 1
        self.bwt = WaveletMatrix(words[order - 1], alphabet)
        counts = np.bincount(words, minlength=alphabet)
        self.first = np.cumsum(counts) - counts
        table = owners[segment[order]].astype(np.int32)
        self.least = [table]
        while 2 * (1 << (len(self.least) - 1)) <= n:
            half = 1 << (len(self.least) - 1)
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = word + 1
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
        return both[: len(word)], both[len(word) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner in each non-empty range."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out


def matched_windows(index: FMIndex, flat: np.ndarray, bounds: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """For every segment and word where a ``window`` starts: is the window indexed with a
    smaller owner? One flag per word of ``flat``; words too near a segment's end are False.

    A segment is streamed by backward search. First from its end as far left as it matches,
    which settles all windows in that stretch; then the windows from the left, each from its
    last word on: where the search stops at word p, no window that spans p and this last
    word matches, so the next one starts after p. All segments step together.
    """
    found = np.zeros(len(flat), bool)
    limit = np.diff(bounds) - window + 1  # windows still open
    lane = np.flatnonzero(limit > 0)
    base, own, limit = bounds[lane], owners[lane], limit[lane]
    start, end = np.zeros(len(lane), np.int64), limit + window - 2
    place, whole = end.copy(), np.ones(len(lane), bool)
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.size, np.int64)
    marks_from, marks_to = [], []
    while len(base):
        low, high = index.step(flat[base + place], low, high)
        good = high > low
        if good.any():
            good[good] = index.least_owner(low[good], high[good]) < own[good]
        place = np.where(good, place - 1, place)
        done = good & (place < start)
        stop = ~good
        # A stretch from the end: the windows that lie in it whole are settled.
        settled = whole & (stop | done)
        left = np.where(done, start, place + 1)
        marked = (settled & (left < limit)) | (done & ~whole)
        marks_from.append((base + left)[marked])
        marks_to.append((base + np.where(whole, limit, start + 1))[marked])
        limit = np.where(settled & stop, np.minimum(limit - 1, place + 1), limit)
        start = np.where(settled & stop, 0, np.where(done, np.where(whole, limit, start + 1), np.where(stop, place + 1, start)))
        fresh = stop | done
        whole = whole & ~fresh
        end = np.where(fresh, start + window - 1, end)
        place = np.where(fresh, end, place)
        low, high = np.where(fresh, 0, low), np.where(fresh, index.size, high)
        alive = ~(fresh & (start >= limit))
        if not alive.all():
            base, own, limit, start, end, place, whole, low, high = (x[alive] for x in (base, own, limit, start, end, place, whole, low, high))
    edges = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edges, np.concatenate(marks_from) if marks_from else np.zeros(0, np.int64), 1)
    np.add.at(edges, np.concatenate(marks_to) if marks_to else np.zeros(0, np.int64), -1)
    found = np.cumsum(edges)[:-1] > 0
    return found
