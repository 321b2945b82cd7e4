"""Full-text index of one shard: suffix ranks, ranks of symbols, backward search and sampled positions.

Small helpers in numpy for the operators that index a bounded shard inside a task; all searches take many queries at once.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (small integers, 0 or more) in order; a suffix comes before those it begins.

    Prefix doubling: as many symbols as fit 62 bits are compared at first; then only suffixes that are still tied are
    ordered anew, by the rank of what follows their known part."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    bits = (int(text.max()) + 1).bit_length()
    width = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key << bits | padded[j:j + n]
    order = np.argsort(key)
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = -1
    place = np.arange(n)  # places of the suffixes that are to be ranked next, and the start of each one's tie
    value, before = key[order], None
    while True:
        new = np.ones(len(place), bool)
        new[1:] = value[1:] != value[:-1]
        if before is not None:
            new[1:] |= before[1:] != before[:-1]
        start = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
        ranks[order[place]] = start
        tied = ~new
        tied[:-1] |= ~new[1:]
        place, before = place[tied], start[tied]
        if not len(place):
            return order
        suffixes = order[place]
        value = ranks[np.minimum(suffixes + width, n)]
        by = np.argsort(before * (n + 2) + value)
        order[place], value, before = suffixes[by], value[by], before[by]
        width *= 2


class BitRanks:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE))

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & _ONE


class WaveletTree:
    """Ranks in a sequence over a large alphabet: one level of bits for each bit of a symbol, highest first."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (values >> shift & 1).astype(bool)
            self.levels.append((BitRanks(bit), int(len(values) - bit.sum()), shift))
            values = np.concatenate([values[~bit], values[bit]])

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place ``i`` leads on the way down to ``symbol``: differences of two such places count the symbol."""
        for bits, zeros, shift in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def symbol_at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where the place leads on the way down to it."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros, _ in self.levels:
            ones, bit = bits.ones(i), bits.bit(i).astype(np.int64)
            i = np.where(bit == 1, zeros + ones, i - ones)
            symbol = symbol << 1 | bit
        return symbol, i


class FMIndex:
    """Counts and finds phrases in ``text`` (symbols 1 to ``symbols`` - 1); every ``sample``-th position is stored."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        text = np.concatenate([text, np.zeros(1, text.dtype)])  # 0 ends the text
        suffixes = suffix_array(text)
        self.n = len(text)
        last = text[suffixes - 1]
        self.tree = WaveletTree(last, symbols)
        every = np.arange(symbols)
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        self.shift = first - self.tree.follow(every, np.zeros(symbols, np.int64))
        stored = suffixes % sample == 0
        self.stored = BitRanks(stored)
        self.positions = suffixes[stored]

    def intervals(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranks [low, high) that begin with each row of ``phrases``, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            low[alive] = self.shift[symbol] + self.tree.follow(symbol, low[alive])
            high[alive] = self.shift[symbol] + self.tree.follow(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def positions_of(self, ranks: np.ndarray) -> np.ndarray:
        """Text position of each suffix rank: steps back through the text to the next stored position."""
        out = np.zeros(len(ranks), np.int64)
        at, left, steps = ranks.copy(), np.arange(len(ranks)), 0
        while len(left):
            here = self.stored.bit(at) == 1
            out[left[here]] = self.positions[self.stored.ones(at[here])] + steps
            left, at = left[~here], at[~here]
            symbol, place = self.tree.symbol_at(at)
            at = self.shift[symbol] + place
            steps += 1
        return out


def spread_ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, member) of every integer in the ranges [low, high)."""
    sizes = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]


class SmallRanks:
    """Ranks in a sequence over a small alphabet: for each symbol, bits that tell the places of smaller ones."""

    def __init__(self, values: np.ndarray, symbols: int):
        blocks = len(values) // 64 + 1
        self.words = np.zeros((blocks, symbols + 1), np.uint64)
        for c in range(symbols + 1):
            self.words[:, c] = BitRanks(values < c).words
        self.before = np.zeros((blocks, symbols + 1), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), axis=0, out=self.before[1:], dtype=np.int32)

    def smaller(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` values are smaller than ``symbol``."""
        at = i >> 6
        return self.before[at, symbol] + np.bitwise_count(self.words[at, symbol] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE))

    def smaller_than_each(self, i: np.ndarray) -> np.ndarray:
        """The same for every symbol: a row per place."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE)[:, None])


class BothWays:
    """Bidirectional index: a phrase can be extended by a symbol at either end.

    A state is (low, back, size): suffix ranks [low, low + size) of the text begin with the phrase, and ranks
    [back, back + size) of the reversed text begin with the reversed phrase."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.concatenate([text, np.zeros(1, text.dtype)])
        self.n, self.symbols = len(text), symbols
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols]
        self.ranks = []
        for t in (text, np.concatenate([text[-2::-1], text[-1:]])):
            self.ranks.append(SmallRanks(t[suffix_array(t) - 1], symbols))

    def start(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, self.n)

    def extend(self, state, symbol: np.ndarray, right: bool):
        """The states after one more symbol at the right or left end; size 0 where there is none."""
        low, back, size = state
        near, far = (back, low) if right else (low, back)
        ranks = self.ranks[right]
        a, b = ranks.smaller(near, symbol), ranks.smaller(near + size, symbol)
        a1, b1 = ranks.smaller(near, symbol + 1), ranks.smaller(near + size, symbol + 1)
        near, far, size = self.first[symbol] + a1 - a, far + b - a, (b1 - a1) - (b - a)
        return (far, near, size) if right else (near, far, size)

    def extend_by_each(self, state, right: bool):
        """(owner, symbol, states) of every way to add a symbol that the text has there."""
        low, back, size = state
        near, far = (back, low) if right else (low, back)
        a, b = self.ranks[right].smaller_than_each(near), self.ranks[right].smaller_than_each(near + size)
        before, counts = np.diff(a, axis=1), np.diff(b, axis=1) - np.diff(a, axis=1)
        owner, symbol = np.nonzero(counts)
        near = self.first[symbol] + before[owner, symbol]
        far = far[owner] + (b - a)[owner, symbol]
        return owner, symbol, ((far, near, counts[owner, symbol]) if right else (near, far, counts[owner, symbol]))
