"""Vectorised polynomial hashing of bytes, words and word n-grams (64 bits)."""

from __future__ import annotations

import numpy as np

_MUL = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so that its powers can be inverted
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
SPACE = np.zeros(256, np.bool_)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below n, modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 16), base, np.uint64)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if len(have) <= 1 << 23:
            _powers[base] = have
    return have[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; words end at ASCII white space."""
    space = SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64) * np.uint64(_MUL))


def word_ngrams(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of words of each text; a shorter text is one gram."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    at, h = word_hashes(np.frombuffer(b" ".join(texts), np.uint8)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    first = np.searchsorted(at, starts)
    grams = h[: max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        grams = grams * _GRAM + h[i : i + len(grams)]
    grams = mix(grams)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        else:
            x = 0
            for w in h[a:z].tolist():
                x = (x * int(_GRAM) + w + 1) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([x] if z > a else [], np.uint64)))
    return out
