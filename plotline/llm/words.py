"""Words of many texts at once: bounds and 64-bit hashes, by array operations."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Base of the polynomial (odd, so that it has an inverse modulo 2^64).
BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z made small."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(size: int) -> list[np.ndarray]:
    if len(_powers[0]) <= size:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size + 1, base, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word (run of non-blank bytes), in order."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    stop = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
    power, inverse = _tables(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], dtype=U, out=sums[1:])
    return mixed((sums[stop] - sums[start]) * inverse[start]), np.searchsorted(bounds, start, "right") - 1


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, ascending within each text, and the bounds of each set.

    A text with fewer than ``size`` words has its whole sequence as one shingle.
    """
    hashes, owner = words(data, bounds)
    texts = len(bounds) - 1
    counts = np.bincount(owner, minlength=texts)
    first = np.r_[0, np.cumsum(counts)]
    have = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(texts), have)
    at = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(have)][:-1], have) + first[doc]
    length = np.minimum(counts, size)[doc]
    value = np.zeros(len(doc), U)
    for k in range(size):
        inside = k < length
        value[inside] = mixed(value[inside] * U(BASE) + hashes[at[inside] + k] + U(1))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.r_[0, np.cumsum(np.bincount(doc, minlength=texts))]


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, as two signed numbers; the same for equal sets."""
    keys = []
    for salt in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(mixed(values ^ salt), dtype=U, out=sums[1:])
        keys.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + (bounds[1:] - bounds[:-1]).astype(U)).view(np.int64))
    return keys[0], keys[1]
