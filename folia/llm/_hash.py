"""Polynomial prefix hashes over bytes, modulo 2 ** 64, and what is built on them.

The hash of bytes [i, j) is (prefix[j] - prefix[i]) * inverse[i]; each byte stands for a random
64-bit number, so the low bits are as good as the high ones.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20_240_117))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    return _more(_BASE, _powers, n)


def prefix(data: np.ndarray) -> np.ndarray:
    """Exclusive prefix hashes of a byte array: one more than it has bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def between(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (pre[end] - pre[start]) * powers(len(pre))[1][start]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the maximal runs of bytes that are not ASCII white space."""
    if not len(data):
        return np.zeros(0, np.uint64)
    white = np.concatenate(([True], WHITE[data], [True]))
    edge = np.flatnonzero(white[1:] != white[:-1])
    return mix(between(prefix(data), edge[::2], edge[1::2]) + (edge[1::2] - edge[::2]).astype(np.uint64))


def shingles(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the lower-cased (A-Z) text; fewer words are one shingle."""
    w = word_hashes(np.frombuffer(text.encode().lower(), np.uint8))
    if not len(w):
        return w
    width = min(k, len(w))
    total = np.full(len(w) - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - width + 1 + i])
    return np.unique(total)


# A second, independent family: other byte numbers and another base.
_BYTE_TWO = np.random.Generator(np.random.PCG64(77_003)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE_TWO = 0xD1342543DE82EF95
_powers_two: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _more(base: int, have: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(have[0]) < n:
        size = max(n, 2 * len(have[0]), 1 << 16)
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            step = np.full(size, np.uint64(b), np.uint64)
            step[0] = 1
            have[k] = np.cumprod(step, dtype=np.uint64)
    return have[0], have[1]


def prefix_two(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_TWO[data] * _more(_BASE_TWO, _powers_two, len(data))[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def between_two(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (pre[end] - pre[start]) * _more(_BASE_TWO, _powers_two, len(pre))[1][start]
