"""FM-index over sequences of word numbers: suffix order, wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions in suffix order. Zeros are separators, each its own symbol, smaller the earlier it stands.

    The first sort packs as many words as fit 62 bits; ties go on by doubling, on the tied suffixes only.
    """
    n = len(text)
    bits = max(1, int(symbols).bit_length())
    depth = max(1, 62 // bits)
    key, plain = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(depth):
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - j)] = text[j:]
        plain &= ahead > 0
        key = (key << bits) | np.where(plain, ahead, 0)
    order = np.argsort(key, kind="stable")
    ordered, open_ = key[order], plain[order]
    slot = np.arange(n, dtype=np.int64)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), slot, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.where(open_, first, slot)
    tied = _tied(first, open_)
    while tied.size:
        at = order[tied]
        group = rank[at] * n + rank[at + depth]
        again = np.argsort(group, kind="stable")
        order[tied] = at[again]
        group = group[again]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), tied, 0))
        rank[order[tied]] = first
        tied = tied[_tied(first, np.ones(len(first), dtype=bool))]
        depth *= 2
    return order


def _tied(first: np.ndarray, open_: np.ndarray) -> np.ndarray:
    same = first[1:] == first[:-1]
    return np.flatnonzero(open_ & (np.concatenate([[False], same]) | np.concatenate([same, [False]])))


class Bits:
    """A bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + b"\0" * (16 - len(packed) % 8), dtype="<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def ones(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletTree:
    """Ranks and look-ups of symbols, one bit vector for each bit of a symbol (levels stored side by side)."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        for shift in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift) & 1 > 0
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.start = np.searchsorted(self._bottom(sequence), self._bottom(np.arange(symbols + 1)))

    def _bottom(self, symbol: np.ndarray) -> np.ndarray:
        """Symbols with their bits reversed: the order of the last level."""
        out = np.zeros_like(symbol)
        for shift, _, _ in self.levels:
            out |= ((symbol >> shift) & 1) << (len(self.levels) - 1 - shift)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1 > 0, zeros + ones, at - ones)
        return at - self.start[symbol]

    def get(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol


class FMIndex:
    """Finds where word sequences occur in a text of word numbers (1 up; 0 separates and never matches).

    The text must end with a separator. Every ``SAMPLE``-th position and each first word behind a separator is sampled.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text, symbols)
        self.size = len(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.tree = WaveletTree(before, symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = Bits(sampled)
        self.samples = order[sampled]

    def search(self, words: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases ``words[end - length : end]``, from the last word back."""
        symbol = words[end - 1]
        low, high = self.smaller[symbol], self.smaller[symbol + 1]
        alive, step = np.flatnonzero((low < high) & (length > 1) & (symbol > 0)), 1
        low, high = np.where(symbol > 0, low, 0), np.where(symbol > 0, high, 0)
        while alive.size:
            symbol = words[end[alive] - 1 - step]
            low[alive] = self.smaller[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = np.where(symbol > 0, self.smaller[symbol] + self.tree.rank(symbol, high[alive]), low[alive])
            step += 1
            alive = alive[(low[alive] < high[alive]) & (length[alive] > step)]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to the next sampled one."""
        place, steps = np.empty(len(rows), dtype=np.int64), 0
        open_, rows = np.arange(len(rows)), rows.copy()
        while open_.size:
            here = self.sampled.get(rows)
            place[open_[here]] = self.samples[self.sampled.ones(rows[here])] + steps
            open_, rows = open_[~here], rows[~here]
            if open_.size:
                symbol = self.tree.get(rows)
                rows = self.smaller[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return place
