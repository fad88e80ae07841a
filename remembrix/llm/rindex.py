"""A run-length index of texts, and the matching statistics of its own texts against all others.

The texts are concatenated with a terminator each. Of the Burrows-Wheeler transform only its runs are kept, with
the text positions (samples) of their first and last rows. A text is streamed from its end to its start: as long
as the row of a suffix lies inside a run, the suffix one to the left has the same neighbour, one longer; only at
the first (or last) row of a run the neighbour changes to what the sampled end of the previous (or the start of
the next) run of that character points at, and the common prefix is measured. The longest match of a position
with any other one is the longer of those with its two neighbours. Common prefixes are measured at the samples only,
by hashes of slices from one running sum over the text: what is kept is the text, that sum, and the runs.
"""

from __future__ import annotations

import numpy as np

from .hashing import mixed, powers


class RunLengthIndex:
    """texts: byte strings. Positions count in the concatenation, whose text k begins at starts[k]."""

    PACK = 7

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.n = int((sizes + 1).sum())
        symbols = np.zeros(self.n + 1, np.int64)  # 0: a terminator
        inside = np.ones(self.n, bool)
        self.ends = self.starts + sizes
        inside[self.ends] = False
        symbols[:-1][inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.symbols, self.inside = symbols, inside
        self.owner = np.repeat(np.arange(len(texts)), sizes + 1)
        self._sort(int(sizes.max(initial=0)) + 1)
        self._runs()

    def _sort(self, longest: int) -> None:
        """The suffix order, by doubling. A terminator is like no other."""
        n, to_end = self.n, self.ends[self.owner] - np.arange(self.n)
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.PACK):
            at = np.minimum(np.arange(n) + k, n)
            value = np.where(alive, self.symbols[at], 0)
            alive &= value > 0
            key = key << 9 | value
        # a suffix whose terminator shows is unlike all others: its text's number decides
        order = np.lexsort((np.where(to_end < self.PACK, self.owner + 1, 0), key))
        second = np.where(to_end < self.PACK, self.owner + 1, 0)[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, (key[order][1:] != key[order][:-1]) | (second[1:] != second[:-1])])
        depth = self.PACK
        while depth < longest and rank.max(initial=-1) < n - 1:
            after = np.zeros(n, np.int64)
            after[:-depth] = rank[depth:] + 1
            after[to_end < depth] = 0
            both = rank * (n + 1) + after
            order = np.argsort(both)
            both = both[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, both[1:] != both[:-1]])
            depth *= 2
        self.array = order if len(order) else np.zeros(0, np.int64)

    def _runs(self) -> None:
        before = self.array - 1
        transform = np.where(before >= 0, self.symbols[before], 0)
        head = np.r_[True, transform[1:] != transform[:-1]] if self.n else np.zeros(0, bool)
        first = np.nonzero(head)[0]
        last = np.r_[first[1:], self.n] - 1 if self.n else first
        self.run_symbol = transform[first]
        #: Text positions of the runs' first and last rows.
        self.first_sample, self.last_sample = self.array[first], self.array[last]
        del self.array

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes at positions a and b, which differ: by halving, up to the nearer end."""
        power, inverse = powers(self.n)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.symbols[: self.n].astype(np.uint64) * power[: self.n], out=sums[1:])
        slices = lambda at, size: mixed((sums[at + size] - sums[at]) * inverse[at])
        low, high = np.zeros(len(a), np.int64), np.minimum(self.ends[self.owner[a]] - a, self.ends[self.owner[b]] - b)
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = slices(a, middle) == slices(b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def matching_statistics(self) -> np.ndarray:
        """At each position the length of the longest match of its suffix with any other one."""
        order = np.lexsort((np.arange(len(self.run_symbol)), self.run_symbol))
        symbol = self.run_symbol[order]
        same = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)
        above, below = order[:-1][same], order[1:][same]
        return np.maximum(self._bordered(below, above, True), self._bordered(above, below, False))

    def _bordered(self, runs: np.ndarray, neighbours: np.ndarray, first: bool) -> np.ndarray:
        mine = self.first_sample if first else self.last_sample
        other = self.last_sample if first else self.first_sample
        # a run without a neighbour of its character: nothing matches there
        lone = np.ones(len(self.run_symbol), bool)
        lone[runs] = False
        lone &= self.run_symbol > 0
        out = np.zeros(self.n, np.int64)
        if not self.n:
            return out
        position = np.concatenate([mine[runs] - 1, mine[lone] - 1, self.ends])
        length = np.concatenate([self.common(mine[runs] - 1, other[neighbours] - 1), np.zeros(int(lone.sum()) + len(self.ends), np.int64)])
        order = np.argsort(position)
        position, length = position[order], length[order]
        at = np.searchsorted(position, np.arange(self.n), "left")  # the next border at or after each position
        return length[at] + position[at] - np.arange(self.n)
