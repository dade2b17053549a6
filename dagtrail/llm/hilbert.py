"""Positions on a Hilbert curve, for many points at once."""

import numpy as np

# Bits of a position; the sign is left alone.
KEY_BITS = 60


def positions(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of whole numbers below 2**bits) on the curve through their cube.

    The usual way from axes to the curve: from the highest bit down, undo what the curve's
    rotations and reflections did to the lower bits, then make Gray code and interleave.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        lower = bit - 1
        for i in range(axes):
            high = (x[i] & bit) != 0
            swapped = np.where(high, 0, (x[0] ^ x[i]) & lower)
            x[0] = np.where(high, x[0] ^ lower, x[0] ^ swapped)
            x[i] ^= swapped
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    odd = np.zeros(x.shape[1], dtype=np.int64)
    for shift in range(bits - 1, 0, -1):
        odd ^= np.where(x[-1] & (1 << shift), (1 << shift) - 1, 0)
    x ^= odd
    key = np.zeros(x.shape[1], dtype=np.int64)
    for shift in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> shift & 1)
    return key
