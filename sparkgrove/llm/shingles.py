"""Word shingles and MinHash signatures of whole texts, in numpy. Pure functions; no Spark."""

from __future__ import annotations

import numpy as np

#: Signature length and the odd multipliers that stand for its permutations.
SYMBOLS = 64
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_C = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_ROWS = 4096
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with A-Z lowered, as random 64-bit values; white space is 0.
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each A-Z lower-cased word [^\\x20\\x09-\\x0D]+, in order."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)
    space = _SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(b) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64)
    ends = np.append(starts[1:], len(b))
    place = np.arange(starts[0], len(b)) - np.repeat(starts, ends - starts)
    b = b[starts[0] :]
    return mix(np.add.reduceat(_BYTE[b] * powers(int(place.max()) + 1)[place], starts - starts[0]))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of A-Z lower-cased words; fewer words than width
    count as one shingle, no words as none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(width, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        acc = mix(acc * _C[k % 3] + h[k : len(h) - n + 1 + k])
    return np.unique(acc)


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of permuted hashes, 16 bits each (uint16), of a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _ROWS):
        y = x[at : at + _ROWS, None] * _MUL + _ADD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(12)
        np.minimum(low, y.min(axis=0), out=low)
    low = low * np.uint32(0x85EBCA6B)
    return (low >> np.uint32(16)).astype(np.uint16)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays, in integers."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a)) if len(b) else 0
    union = len(a) + len(b) - both
    return union > 0 and 100 * both >= percent * union
