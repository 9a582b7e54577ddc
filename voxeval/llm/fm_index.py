"""A full-text index of one shard: the Burrows-Wheeler transform of its words in a wavelet tree.

The transform is kept as bit planes (one bit a word and plane, with a running count every 64 bits); a rank query goes down the
planes, and a backward step narrows the range of suffixes that start with a pattern by one word to the left. All queries of
a shard step together as numpy arrays. Suffixes are sorted by their first words only, as many as a pattern may have: ranges
of such patterns are the same as in a full sort.
"""

from __future__ import annotations

import numpy as np

#: Symbol between pieces and after the last one; words are numbered from 1.
END = 0


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` symbols; equal ones in any order."""
    rank, done = text.astype(np.int64), 1
    while True:
        bits = max(1, int(rank.max(initial=0) + 1).bit_length())
        parts = max(2, 63 // bits)  # as many ranks as one number holds, each ``done`` symbols further
        key = rank + 1
        for k in range(1, parts):
            key <<= bits
            key[: max(0, len(rank) - k * done)] += rank[k * done :] + 1
        order = np.argsort(key)
        done *= parts
        if done >= depth:
            return order
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(len(order), np.int64)
        rank[order] = step


#: The bits below each place of a word.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class BitPlane:
    """Bits with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view("<u8")
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & BELOW[at & 63])


class WaveletTree:
    """Counts of a symbol before a place in a sequence; the nodes of a level stand side by side in one plane."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.planes, self.zeros = [], []
        for level in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bits = (seq >> level) & 1
            self.planes.append(BitPlane(bits.astype(np.uint8)))
            self.zeros.append(int(len(bits) - bits.sum()))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Counts of each symbol before a place, plus where its node starts in the last level."""
        top = len(self.planes) - 1
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.ones(at)
            at = np.where((symbol >> (top - level)) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of a text of words numbered from 1, whose pieces are each followed by END; patterns have ``depth`` words at most."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.places = sorted_suffixes(text, depth + 1).astype(np.int32)
        symbols = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletTree(text[self.places - 1], symbols)
        every = np.arange(symbols)
        self.shift = self.first[:-1] - self.tree.rank(every, np.zeros(symbols, np.int64))

    def step(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns that have ``symbol`` before those of the given ranges."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([start, end]))
        shift = self.shift[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def statistics(self, text: np.ndarray, occurrences: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of ``text``, by backward search from each of its places.

        Per place: the length of the longest run of words that ends there and occurs ``occurrences`` times in the index,
        ``depth`` at most and within its piece, with the range of its suffixes.
        """
        n = len(text)
        length, low, high = np.zeros(n, np.int32), np.zeros(n, np.int64), np.full(n, len(self.text), np.int64)
        alive = np.flatnonzero(text != END)
        for k in range(self.depth):
            alive = alive[alive >= k]
            alive = alive[text[alive - k] != END]
            if not len(alive):
                break
            symbol = text[alive - k]
            start, end = self.step(symbol, low[alive], high[alive]) if k else (self.first[symbol], self.first[symbol + 1])
            more = end - start >= occurrences
            alive = alive[more]
            low[alive], high[alive], length[alive] = start[more], end[more], k + 1
        return length, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in the index of the patterns of some ranges, each of which is equal to or apart from the others."""
        ranges, back = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
        if not len(ranges):
            return np.zeros(0, np.int64)
        found = np.minimum.reduceat(np.append(self.places, np.int32(np.iinfo(np.int32).max)), ranges.ravel())[::2]
        return found[back.ravel()].astype(np.int64)
