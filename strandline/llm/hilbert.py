"""Hilbert curve keys in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``grid`` (n, d), cells of ``bits`` bits a side, on the Hilbert curve.

    The published transpose method: from the highest bit down, reflect or swap the lower bits of
    the axes, then Gray-decode; bits of the axes are then interleaved. d * bits is at most 63.
    """
    x = grid.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key
