"""Hashes of the words and word shingles of many texts at a time, with numpy.

Words are the runs between ASCII white space, with A-Z in lower case.  A word's 64-bit hash is a
polynomial in an odd base over a fixed table of byte values, taken from running sums over the block.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE, INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base)]))
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def blocks(texts: list[bytes | None], size: int = 2 << 20):
    """Lists of consecutive texts of about `size` bytes; a longer text stands alone."""
    block, n = [], 0
    for t in texts:
        block.append(t or b"")
        n += len(block[-1])
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    joined = b" ".join(texts).translate(LOWER)
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[data] * powers(BASE, len(data)), dtype=np.uint64)])
        words = mix((sums[end] - sums[start]) * powers(INVERSE, len(data))[start])
    bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, bounds)]))
    return words, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order; of a shorter text, that of all its words."""
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    width = np.repeat(np.minimum(counts, k), n)
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for i in range(k):
            out = np.where(i < width, mix(out ^ padded[at + i]) * BASE + _U(i + 1), out)
    return mix(out), n
