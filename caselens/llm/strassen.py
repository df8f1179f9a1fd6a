"""Exact integer matrix products by Strassen's recursion in numpy."""

from __future__ import annotations

import numpy as np

LEAF = 24


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven products of halves instead of eight.

    Odd sides are filled up with zeros, and halves whose shortest side is ``leaf`` or less are
    multiplied plainly. Sums and products are taken modulo 2**64, a ring, so the result is
    exact whenever it fits 64 bits, however large sums in between become.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    lower = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    left = strassen(a22, b21 - b11, leaf)
    upper = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t] = both + left - upper + strassen(a12 - a22, b21 + b22, leaf)
    out[:r, t:] = right + upper
    out[r:, :t] = lower + left
    out[r:, t:] = both - lower + right + strassen(a21 - a11, b11 + b12, leaf)
    return out[:m, :n]
