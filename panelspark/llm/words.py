"""Word hashes of many texts at once, by running polynomial hashes over their bytes."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1


@cache
def _powers(base: int, size: int) -> np.ndarray:
    """base^0 .. base^(size-1) modulo 2^64; size is a power of two, so that few tables are kept."""
    out = np.ones(size, dtype=np.uint64)
    out[1:] = base & (2**64 - 1)
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, n of each."""
    size = 1 << max(10, (n - 1).bit_length())
    return _powers(base, size)[:n], _powers(pow(base, -1, 2**64), size)[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its text); words are runs of ASCII letters and digits and of
    anything beyond ASCII, lower-cased."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]) + b" ", dtype=np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(BASE, len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = mixed((total[end] - total[start]) * down[start])
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return h, np.searchsorted(first, start, "right") - 1


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, unmixed positions 0 .. len - k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(WORD_BASE) + h[j:j + n]
    return mixed(out ^ np.uint64(k))
