"""Vectorised word hashes for code that runs inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values: multiply and shift until every bit depends on every other."""
    x = x + np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word between ASCII blanks."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64)
    length = last - first
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    terms = (raw[at].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place]
    return mix(np.add.reduceat(terms, np.cumsum(length) - length))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + words[j : j + n]
    return mix(total)
