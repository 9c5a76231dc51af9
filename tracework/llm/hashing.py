"""Hashes of consecutive values, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each (a, b).  The seed enters before a mix of ``a`` that is not linear, so that pairs that
    collide under one seed do not under others."""
    h = (a ^ _U(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * _A
    h ^= h >> _U(31)
    h = (h + b) * _A
    h ^= h >> _U(32)
    h *= _B
    h ^= h >> _U(29)
    return h


def rolling(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``n`` consecutive values, from those of powers of two."""
    out, at, size, power = None, 0, 1, x
    while at < n:
        if (n >> (size.bit_length() - 1)) & 1:
            part = power[at:]
            out = part if out is None else pair(out[: len(part)], part, seed + n)
            at += size
        if at < n:
            power = pair(power[:-size], power[size:], seed + size)
            size *= 2
    return out[: max(0, len(x) - n + 1)]


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    size, m = 1, x
    while 2 * size <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - size : n - size + len(x) - n + 1])
