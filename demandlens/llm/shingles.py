"""Word shingles of a text as 64-bit hashes (numpy, used inside tasks).

Words are runs of bytes other than space and \\t-\\r, with A-Z lower-cased.
A text with fewer than ``k`` words has its whole sequence as its one shingle;
a text without words (or null) has none.  Hash equality stands for shingle
equality: 64 bits, so a false match within one pair of documents has a
chance below 1e-9.
"""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_MULT, _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """One hash a word, in order."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    if not len(edge):
        return np.zeros(0, dtype=np.uint64)
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    run = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * up[:-1], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts])


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Hashes of the ``k``-word shingles in order, repeats included."""
    w = word_hashes(text)
    n = min(k, len(w))
    if n == 0:
        return w
    out = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out * _MULT + w[i:len(w) - n + 1 + i]
    return mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingles(text, k))
