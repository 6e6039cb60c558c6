"""Arithmetic modulo 2^61 - 1 on arrays of 64-bit integers."""

from __future__ import annotations

import numpy as np

MERSENNE_61 = (1 << 61) - 1

_P = np.uint64(MERSENNE_61)
_HALF, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def affine(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """(a * x + b) mod 2^61 - 1 of numbers below it, by halves of 31 bits: 2^62 is 2 there, and a sum of middle products m
    stands for (m >> 30) + (m mod 2^30) * 2^31; no partial sum reaches 2^64."""
    a1, a0 = np.uint64(a >> 31), np.uint64(a) & _HALF
    x1, x0 = x >> np.uint64(31), x & _HALF
    middle = a1 * x0 + a0 * x1
    y = np.uint64(2) * (a1 * x1) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + a0 * x0 + np.uint64(b)
    y = (y & _P) + (y >> np.uint64(61))
    y = (y & _P) + (y >> np.uint64(61))
    return np.where(y >= _P, y - _P, y)
