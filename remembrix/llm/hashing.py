"""Polynomial hashes of all slices of a byte array, modulo 2**64, from one prefix sum."""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base and of its inverse; kept for the next call."""
    have = _tables.get(which)
    if have is None or len(have[0]) <= n:
        size = 1 << (n + 1).bit_length()
        have = tuple(_geometric(b, size) for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)))
        if size <= 1 << 23:
            _tables[which] = have
    return have[0][: n + 1], have[1][: n + 1]


def _geometric(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
