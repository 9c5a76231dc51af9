"""Static range asymmetric numeral system over blocks of interleaved lanes, in numpy.

One frequency table serves all blocks of a segment.  A block is ``STEPS`` x ``LANES`` symbols; its
lanes share one stream of 32-bit words, read in lane order, so all blocks of a segment are decoded
side by side, or any block alone from its checkpoint (states and place in the stream).
"""

from __future__ import annotations

import numpy as np

LANES, STEPS = 64, 1024
BLOCK = LANES * STEPS
#: Frequencies add up to 2 ** SCALE; states stay in [2 ** 31, 2 ** 63).
SCALE = 20
_LOW = np.uint64(1 << 31)
_U = np.uint64


def frequencies(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols in order and their frequencies, each 1 at least, 2 ** SCALE in all."""
    counts = np.bincount(symbols)
    names = np.flatnonzero(counts)
    counts = counts[names]
    if len(names) > 1 << (SCALE - 2):
        raise ValueError(f"{len(names)} symbols are too many for {SCALE} bits")
    freq = np.maximum(1, counts.astype(np.float64) * (1 << SCALE) / counts.sum()).astype(np.int64)
    over = int(freq.sum()) - (1 << SCALE)
    for i in np.argsort(-freq, kind="stable"):  # what rounding left goes to, or comes from, the most frequent
        if not over:
            break
        change = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= change
        over -= change
    return names, freq


def encode(symbols: np.ndarray, names: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """States (blocks x LANES) and each block's words; the last block is filled up with its last symbol."""
    blocks = -(-len(symbols) // BLOCK)
    place = np.zeros(int(names[-1]) + 1, np.int32)  # a table from symbol to index: no search per symbol
    place[names] = np.arange(len(names))
    index = place[symbols]
    index = np.concatenate([index, np.full(blocks * BLOCK - len(index), index[-1])]).reshape(blocks, STEPS, LANES)
    f, c = freq.astype(_U), (np.cumsum(freq) - freq).astype(_U)
    x = np.full((blocks, LANES), _LOW, _U)
    words, used = np.zeros((STEPS, blocks, LANES), np.uint32), np.zeros((STEPS, blocks, LANES), bool)
    for t in range(STEPS - 1, -1, -1):
        s = index[:, t]
        fs = f[s]
        full = x >= fs << _U(63 - SCALE)
        words[t], used[t] = x.astype(np.uint32), full
        x = np.where(full, x >> _U(32), x)
        q = x // fs
        x = (q << _U(SCALE)) + (x - q * fs) + c[s]
    return x, [words[:, b][used[:, b]] for b in range(blocks)]


def decode(states: np.ndarray, words: np.ndarray, starts: np.ndarray, names: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """All symbols of the blocks, whose words begin at ``starts`` in ``words``."""
    f, c = freq.astype(_U), (np.cumsum(freq) - freq).astype(_U)
    slot_symbol = np.repeat(np.arange(len(names)), freq)
    words = np.concatenate([words, np.zeros(1, np.uint32)]).astype(_U)
    x, at, mask = states.copy(), starts.astype(np.int64), _U((1 << SCALE) - 1)
    out = np.empty((len(states), STEPS, LANES), names.dtype)
    for t in range(STEPS):
        slot = x & mask
        s = slot_symbol[slot.astype(np.int64)]
        out[:, t] = names[s]
        x = f[s] * (x >> _U(SCALE)) + slot - c[s]
        low = x < _LOW
        order = np.cumsum(low, axis=1)
        place = np.where(low, at[:, None] + order - 1, len(words) - 1)
        x = np.where(low, (x << _U(32)) | words[place], x)
        at += order[:, -1]
    if (x != _LOW).any():
        raise ValueError("a block does not end in its first state: the stream is damaged")
    return out.reshape(len(states), BLOCK)
