"""Seeded bijections of 0 ... n - 1, for dealing values out to other rows."""
from __future__ import annotations

import numpy as np

ROUNDS = 4


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def deal(ranks: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Image of each rank under the bijection of 0 ... n - 1 that its key names.

    A Feistel network permutes the smallest even power of two that holds n; a
    value beyond n goes through it again, which leads back below n.
    """
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, keys = ranks.astype(np.uint64), keys.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        a, b = out[left] >> half, out[left] & mask
        for i in range(ROUNDS):
            a, b = b, a ^ (_spread(b * np.uint64(ROUNDS) + np.uint64(i) + _spread(keys[left])) & mask)
        out[left] = (a << half) | b
        left = left[out[left] >= n]
    return out.astype(np.int64)
