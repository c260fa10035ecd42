"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words; A-Z count as a-z, words end at a blank and at
    \\x09-\\x0D. A text with fewer words, but some, is one shingle."""
    if not 1 <= words <= len(_FACTORS):
        raise ValueError(f"words must be from 1 to {len(_FACTORS)}")
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    k = min(words, len(parts))
    h = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in parts]), dtype=np.uint64)
    if not k:
        return h
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _FACTORS[i]
    return np.unique(mixed(total))


def set_digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())
