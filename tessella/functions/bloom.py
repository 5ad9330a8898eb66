"""The Bloom filter of shard summaries: 131,072 bits, seven positions a key."""

from __future__ import annotations

import numpy as np

from tessella.functions.blake3 import digests

BITS, HASHES = 131_072, 7
WORDS = BITS // 64
DOMAIN = b"tessella shard summary v1\0"
SATURATED = 0.95


def positions(keys: list[bytes]) -> np.ndarray:
    """Bit positions, keys x HASHES: h1 + i * h2 over wrapping 64-bit words of one digest."""
    d = digests([DOMAIN + k for k in keys]).astype(np.uint64)
    h1, h2 = d[:, 0] | d[:, 1] << np.uint64(32), d[:, 2] | d[:, 3] << np.uint64(32) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((h1[:, None] + np.arange(HASHES, dtype=np.uint64) * h2[:, None]) % np.uint64(BITS)).astype(np.int64)


def bitmap(keys: list[bytes]) -> np.ndarray:
    """The filter of keys, as WORDS 64-bit words."""
    out = np.zeros(WORDS, np.uint64)
    if keys:
        at = np.unique(positions(keys))
        np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def holds(words: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Whether each key may be in the filter; never False for one that is."""
    if not keys:
        return np.zeros(0, bool)
    at = positions(keys)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def occupied(words: np.ndarray) -> float:
    return float(np.bitwise_count(words).sum()) / BITS


def false_positive_ppm(words: np.ndarray) -> int:
    return round(occupied(words) ** HASHES * 1_000_000)


def saturated(words: np.ndarray) -> bool:
    """A filter this full excludes nothing worth asking."""
    return occupied(words) >= SATURATED
