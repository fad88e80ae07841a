"""Byte-pair merging of many sequences at once: one flat array of symbols, one round for all of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: The rank of a pair that doesn't merge.
NEVER = np.int64(1) << 62


class Pairs:
    """Mergeable pairs: rank and merged symbol by a sorted key."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.base = 1 + max((max(p) for p in pairs), default=0)
        keys = np.array([a * self.base + b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], values[order, 0], values[order, 1]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER: no such pair) and merged symbol of each pair; symbols below 0 pair with nothing."""
        if not len(self.keys):
            return np.full(len(left), NEVER), np.zeros(len(left), np.int64)
        key = np.where((left < 0) | (right < 0) | (right >= self.base), -1, left * self.base + right)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.made[at]


def merge_ragged(symbol: np.ndarray, owner: np.ndarray, look: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Surviving symbols, and where in the input each begins. owner: each symbol's sequence, the symbols of one together.

    In a round each sequence merges its lowest-rank pair, the leftmost one on ties; those without one leave.
    """
    n = len(symbol)
    place = np.arange(n)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    if n:
        rank, made = look(symbol[:-1], symbol[1:])
        rank, made = np.append(rank, NEVER), np.append(made, 0)
        rank[:-1][owner[1:] != owner[:-1]] = NEVER
    symbol = symbol.copy()
    while len(symbol):
        starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        sizes = np.diff(np.r_[starts, len(owner)])
        lowest = np.minimum.reduceat(rank, starts)
        ended = lowest == NEVER
        if ended.any():
            gone = np.repeat(ended, sizes)
            done.append((symbol[gone], place[gone]))
            stay = ~gone
            symbol, owner, rank, made, place = symbol[stay], owner[stay], rank[stay], made[stay], place[stay]
            lowest, sizes = lowest[~ended], sizes[~ended]
            if not len(symbol):
                break
        hit = np.nonzero(rank == np.repeat(lowest, sizes))[0]
        left = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]  # the leftmost of each sequence
        symbol[left] = made[left]
        keep = np.ones(len(symbol), bool)
        keep[left + 1] = False
        left = left - np.arange(len(left))  # where they are once the right halves have gone
        symbol, owner, rank, made, place = symbol[keep], owner[keep], rank[keep], made[keep], place[keep]
        at = np.concatenate([left, left[left > 0] - 1])
        rank[at] = NEVER
        at = at[at + 1 < len(symbol)]
        at = at[owner[at] == owner[at + 1]]
        rank[at], made[at] = look(symbol[at], symbol[at + 1])
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol, place = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(place)
    return symbol[order], place[order]
