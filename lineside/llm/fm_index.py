"""A compressed FM-index over sequences of words, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


#: The bits below each place of a block.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Bits of a sequence level by level, packed, with a count for each 64; ranks for arrays of positions."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.bits, self.counts, self.zeros = levels, [], [], []
        for at in range(levels - 1, -1, -1):
            bit = (values >> at & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1]]).astype(np.int32))
            self.zeros.append(np.int32(len(bit) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions ``at`` lead, following each symbol's bits; from 0 it is where the symbol's rows begin."""
        symbols, at = symbols.astype(np.int32), at.astype(np.int32)
        for level in range(self.levels):
            block = at >> 6
            ones = self.counts[level].take(block)
            ones += np.bitwise_count(self.bits[level].take(block) & _BELOW.take(at & 63))
            at -= ones
            # The negated bit is a mask: where it is set, ``at`` becomes zeros + ones.
            at += (ones + self.zeros[level] - at) & -(symbols >> (self.levels - 1 - level) & 1)
        return at.astype(np.int64)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of small non-negative numbers, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        key = rank * (max(n, int(rank.max())) + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[order[-1]] == n - 1 or step >= n - 1:
            return order
        rank, step = new, step * 2


class FmIndex:
    """An index of pieces of text; words are any integers."""

    def __init__(self, pieces: list[np.ndarray]):
        self.words = np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)
        ends = len(pieces)
        # Every piece ends in a sign of its own, smaller than all words, so no match crosses a piece.
        text = np.concatenate([x for i, p in enumerate(pieces) for x in (np.searchsorted(self.words, p) + ends, np.array([i]))])
        order = suffix_order(text)
        before = text[order - 1]
        symbols = ends + len(self.words)
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(before, max(1, int(symbols - 1).bit_length()))
        self.begin = self.tree.descend(np.arange(symbols), np.zeros(symbols, np.int64))
        self.shift = ends

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words that all occur in the index."""
        return np.searchsorted(self.words, words) + self.shift

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A backward step: the rows of each match with the symbol before it."""
        base = self.first[symbols] - self.begin[symbols]
        both = self.tree.descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return base + both[:len(symbols)], base + both[len(symbols):]

    def repeated(self, patterns: list[np.ndarray], window: int) -> np.ndarray:
        """For each pattern (itself in the index) a bit mask of the windows that occur at least twice.

        From an end, matches are extended to the left while they occur twice. Where that stops, the
        windows to the right of the stop are repeated, and none that holds the stop up to this end
        is; the next end is the last one that could still hold another window. All patterns move
        together, a step at a time. Ahead of that, each pattern's core (the words that all its
        windows hold) is looked up; where it occurs once, so does every window.
        """
        length = np.array([len(p) for p in patterns], np.int64)
        start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        codes = self.codes(np.concatenate(patterns)) if len(patterns) else np.zeros(0, np.int64)
        masks = np.zeros(len(patterns), np.int64)
        end, at = length.copy(), length.copy()
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)

        def restart(which: np.ndarray) -> None:
            """The rows of the last word before an end are known without a step."""
            last = codes[start[which] + end[which] - 1]
            low[which], high[which], at[which] = self.first[last], self.first[last + 1], end[which] - 1

        live = long = np.flatnonzero(length >= window)
        core = np.maximum(length - window, 0)
        live = live[core[live] < window]
        end[live] = window
        restart(live)
        live, once = live[at[live] > core[live]], np.zeros(len(patterns), bool)
        while len(live):
            low[live], high[live] = self.extend(codes[start[live] + at[live] - 1], low[live], high[live])
            at[live] -= 1
            lone = high[live] - low[live] < 2
            once[live[lone]] = True
            live = live[~lone & (at[live] > core[live])]
        live = long[~once[long]]
        end[live] = length[live]
        restart(live)
        while len(live):
            low2, high2 = self.extend(codes[start[live] + at[live] - 1], low[live], high[live])
            more = high2 - low2 >= 2
            go = live[more]
            low[go], high[go] = low2[more], high2[more]
            at[go] -= 1
            stop = np.concatenate([live[~more], go[at[go] == 0]])
            count = end[stop] - window - at[stop] + 1  # windows that start at ``at`` and later
            good = count > 0
            masks[stop[good]] |= ((np.int64(1) << count[good]) - 1) << at[stop[good]]
            end[stop] = np.where(at[stop] == 0, 0, np.minimum(end[stop] - 1, at[stop] - 1 + window))
            restart(stop[end[stop] >= window])
            live = live[end[live] >= window]
        return masks
