"""Hashes of words and word shingles of whole texts, computed with array operations."""

from __future__ import annotations

from functools import cache

import numpy as np

_ODD = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _bytes_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as texts need."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            step = np.full(size, _ODD, np.uint64)
            back = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            cls.up, cls.down = np.cumprod(step), np.cumprod(back)
        return cls.up, cls.down


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word; words are runs of bytes other than ASCII white space."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.of(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_bytes_table()[raw] * up[: len(raw)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(text: bytes, width: int = 5) -> np.ndarray:
    """One hash per run of `width` words, in order; a shorter text is one shingle, a text without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
    return mix(out)
