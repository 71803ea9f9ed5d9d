"""64-bit hashes of many words of a text at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(33)) * U(0xFF51AFD7ED558CCD)
    x = (x ^ x >> U(33)) * U(0xC4CEB9FE1A85EC53)
    return x ^ x >> U(33)


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, BASE, np.uint64))


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers; the table that is kept is a few hundred kilobytes, longer ones are made for a text."""
    return _powers(1 << 15) if n <= 1 << 15 else np.cumprod(np.full(n, BASE, np.uint64))


def word_bounds(b: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of bytes ``b`` begin and end; ``inside`` has for each byte whether it belongs to a word."""
    marks = np.zeros(len(b) + 2, np.int8)
    marks[1:-1] = inside[b]
    steps = np.diff(marks)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: bytes weighed by their places in it, and its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    parts = BYTE[b[place + np.repeat(starts, sizes)]]
    parts *= powers(int(sizes.max()))[place]
    return mixed(np.add.reduceat(parts, first) + sizes.astype(np.uint64))
