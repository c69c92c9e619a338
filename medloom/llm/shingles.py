"""Hashed words and word shingles of whole texts, in numpy inside Spark tasks."""

from __future__ import annotations

import numpy as np

#: Words hashed at a time, which bounds the memory that a very long text takes.
STEP = 1 << 16
# The base of rolling hashes, an odd number, and its inverse modulo 2**64.
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte; A-Z have those of a-z.
_LETTERS = np.random.default_rng(6).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[65:91] = _LETTERS[97:123]


def powers(base: int, n: int) -> np.ndarray:
    """The powers of a number modulo 2**64, from 0 to n."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_UP, _DOWN = powers(BASE, 1 << 16), powers(INVERSE, 1 << 16)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
    return edge[::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text with A-Z lower-cased: running sums of byte numbers times powers of the base."""
    data = np.frombuffer(text, np.uint8)
    start, end = word_places(data)
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(start), STEP):
        a, b = start[at : at + STEP], end[at : at + STEP]
        n = int(b[-1] - a[0])
        up, down = (_UP, _DOWN) if n < len(_UP) else (powers(BASE, n), powers(INVERSE, n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data[a[0] : b[-1]]] * up[:n], out=total[1:])
        a, b = a - a[0], b - a[0]
        out[at : at + STEP] = mixed((total[b] - total[a]) * down[a])
    return out


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """The set of k-word shingles as sorted distinct 64-bit hashes; fewer words make one shingle, none an empty set."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    k, salt = (k, 0) if len(w) >= k else (len(w), len(w))
    n = len(w) - k + 1
    h = np.full(n, salt, np.uint64)
    for i in range(k):
        h = h * np.uint64(BASE) + w[i : i + n]
    h = np.sort(mixed(h))
    return h[np.append(True, h[1:] != h[:-1])]
