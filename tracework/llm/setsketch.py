"""SetSketch registers: exponentially spaced, truncated minima of hashed elements (Ertl, 2021).

Each register holds floor(1 - log_b(least exponential variate)), cut to 16 bits.  Registers of a
union are the greater ones of its parts, register by register, and the shares of greater, lesser and equal
registers give two sets' similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

from .hashing import pair

#: Registers, base, rate of the exponential variates, largest register value.
REGISTERS, BASE, RATE, LIMIT = 80, 1.001, 20.0, 65535
_U = np.uint64


def registers(elements: np.ndarray, starts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (sets x m, 16 bits) of the sets that begin at ``starts`` in ``elements``; none empty."""
    out = np.empty((len(starts), m), np.uint16)
    for j in range(m):
        low = np.minimum.reduceat(pair(elements, elements, 2 * j + 1), starts)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, j] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair of rows, by the likelihood of greater, lesser and equal registers."""
    more, fewer = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - fewer
    u = size_a / (size_a + size_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
        return more * np.log(up) + fewer * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave in j: golden section
        step = (high - low) * 0.381966
        c, d = low + step, high - step
        left = likelihood(c) >= likelihood(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2
