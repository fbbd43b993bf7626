"""A minimal perfect hash over 64-bit keys: a cascade of bit arrays, numpy throughout.

At each level the keys left are hashed into about twice as many bits; keys alone on their bit
settle there, the others go on. A key's slot is the number of set bits before its bit.
"""

from __future__ import annotations

import numpy as np

LEVELS = 48
GAMMA = 2.0


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of xor-shifts and odd multiplications; fixed constants."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return mix(keys, 1_000_003).astype(np.uint32)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """sizes (words per level), words (the bits) and ranks (set bits before each word)."""
    left, words = keys.astype(np.uint64), []
    for level in range(LEVELS):
        if not len(left):
            break
        n = max(1, int(np.ceil(GAMMA * len(left) / 64)))
        at = mix(left, level) % np.uint64(64 * n)
        alone = np.bincount(at.astype(np.int64), minlength=64 * n)[at.astype(np.int64)] == 1
        bits = np.zeros(64 * n, dtype=np.uint8)
        bits[at[alone].astype(np.int64)] = 1
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        left = left[~alone]
    if len(left):
        raise ValueError("keys are not distinct")
    flat = np.concatenate(words) if words else np.zeros(0, dtype="<u8")
    counts = np.bitwise_count(flat).astype(np.int64)
    return {
        "sizes": np.array([len(w) for w in words], dtype="<i8"),
        "words": flat.astype("<u8"),
        "ranks": (np.cumsum(counts) - counts).astype("<i8"),
    }


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for keys that are surely unknown (others need a fingerprint)."""
    out, base = np.full(len(keys), -1, dtype=np.int64), 0
    open_ = np.arange(len(keys))
    keys = keys.astype(np.uint64)
    for level, n in enumerate(index["sizes"].tolist()):
        at = mix(keys[open_], level) % np.uint64(64 * n)
        word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        hit = (index["words"][word] >> bit) & np.uint64(1) == 1
        low = index["words"][word] & ((np.uint64(1) << bit) - np.uint64(1))
        out[open_[hit]] = index["ranks"][word[hit]] + np.bitwise_count(low[hit])
        open_, base = open_[~hit], base + n
    return out
