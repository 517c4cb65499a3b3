"""A compressed FM-index over sequences of words, in numpy.

The Burrows-Wheeler transform of the sequences, each with an end mark of its own, lies in a wavelet matrix:
a packed bitvector with a popcount directory for each bit of a symbol. Backward search adds a word in front of a
pattern by two ranks. Sequences carry weights (how often they occur), and a running sum of weights
along the rows of the index tells how often a pattern occurs in all.

All searches of a batch go on side by side, a word a step.
"""

from __future__ import annotations

import numpy as np

from graphcall.llm.fim import BitVector


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by doubling; of equal sequences an end mark (a symbol that occurs once) ends each comparison."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)

    def ranks_of(at: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Ranks of suffixes that stand in order: the place of the first one with the same key."""
        new = np.ones(len(at), bool)
        new[1:] = keys[1:] != keys[:-1]
        return first[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]

    places = np.arange(n)
    rank[order] = ranks_of(order, symbols[order], places)
    width = 1
    # Only suffixes whose rank others share are looked at again.
    open_ = places
    while len(open_):
        own = rank[order[open_]]
        same = np.zeros(len(open_), bool)
        if len(open_) > 1:
            equal = own[1:] == own[:-1]
            same[1:] |= equal
            same[:-1] |= equal
        open_ = open_[same]
        if not len(open_):
            break
        at = order[open_]
        ahead = at + width
        key = rank[at] * np.int64(n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_] = at[by]
        rank[order[open_]] = ranks_of(open_, key[by], open_)
        width *= 2
    return order


class WaveletMatrix:
    """Symbols by place, as one bitvector a bit; counts of a symbol in front of places."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.bits = max(1, int(kinds - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((BitVector(ones), int((~ones).sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the count of ``symbol`` in front of ``at`` ends, from where it begins for place 0."""
        for k, (vector, zeros) in enumerate(self.levels):
            ones = vector.rank(at)
            at = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """An index of sequences of word numbers (from 1; below ``kinds``), ``flat`` from ``starts`` on, each with a weight."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, weights: np.ndarray, kinds: int):
        count, sizes = len(weights), np.diff(starts)
        # Every sequence gets an end mark, in order below all words.
        place = np.arange(len(flat)) + np.repeat(np.arange(count), sizes)
        text = np.empty(len(flat) + count, np.int64)
        text[place] = flat + count - 1
        ends = starts[1:] + np.arange(count)
        text[ends] = np.arange(count)
        order = suffix_order(text)
        owner = np.repeat(np.arange(count), sizes + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])
        before = text[order - 1] - count + 1
        before[before < 0] = 0
        self.matrix = WaveletMatrix(before, kinds)
        amount = np.bincount(flat, minlength=kinds)
        amount[0] = count
        self.first = np.concatenate([[0], np.cumsum(amount)])
        symbols = np.arange(kinds)
        self.shift = self.first[:-1] - self.matrix.down(np.zeros(kinds, np.int64), symbols)

    def extend(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of patterns with a word more in front."""
        at = self.matrix.down(np.concatenate([low, high]), np.concatenate([word, word])) + np.tile(self.shift[word], 2)
        return at[: len(low)], at[len(low) :]

    def often(self, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
        return self.weight[high] - self.weight[low] >= least


def repeated_windows(index: FMIndex, flat: np.ndarray, starts: np.ndarray, size: int, least: int = 2) -> np.ndarray:
    """For each place of ``flat`` whether a window of ``size`` words that starts there, inside its sequence, occurs ``least`` times.

    Matching statistics from the right: a sequence's end is followed to the left as far as it occurs often enough, which
    settles all windows within that stretch. The others are tried from the left. A try reads its window backward; where it
    fails, all windows over that point up to the window's end fail with it, and the next try starts behind it.
    """
    found = np.zeros(len(flat), bool)
    sizes = np.diff(starts)
    of = np.flatnonzero(sizes >= size)
    if not len(of):
        return found
    base, end = starts[of], starts[of + 1]
    at, low, high = end - 1, index.first[flat[end - 1]], index.first[flat[end - 1] + 1]
    reached = end.copy()
    alive = np.arange(len(of))
    alive = alive[index.often(low, high, least)]
    low, high = low[alive], high[alive]
    while len(alive):
        reached[alive] = at[alive]
        at[alive] -= 1
        more = at[alive] >= base[alive]
        alive, low, high = alive[more], low[more], high[more]
        low, high = index.extend(low, high, flat[at[alive]])
        more = index.often(low, high, least)
        alive, low, high = alive[more], low[more], high[more]
    last = end - size  # the last window's start
    mark = np.zeros(len(flat) + 1, np.int64)
    some = reached <= last
    np.add.at(mark, reached[some], 1)
    np.add.at(mark, last[some] + 1, -1)
    found |= np.cumsum(mark[:-1]) > 0

    # What is left lies before the stretch; the last window has failed where the stretch is too short.
    limit = np.where(some, reached, last)
    left = base < limit
    start, limit = base[left], limit[left]
    at = start + size - 1
    low, high = index.first[flat[at]], index.first[flat[at] + 1]
    while len(start):
        often = index.often(low, high, least)
        whole = often & (at == start)
        found[start[whole]] = True
        again = whole | ~often
        start = np.where(whole, start + 1, np.where(often, start, at + 1))
        go = start < limit
        start, limit, at, low, high, again = start[go], limit[go], at[go], low[go], high[go], again[go]
        at = np.where(again, start + size - 1, at - 1)
        word = flat[at]
        low[again], high[again] = index.first[word[again]], index.first[word[again] + 1]
        on = ~again
        low[on], high[on] = index.extend(low[on], high[on], word[on])
    return found
