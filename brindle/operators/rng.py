"""Sequential generators, one per entity, in numpy over whole columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.hash64 import GAMMA, MASK, MIX_1, MIX_2, seed_key


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of each number."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def entity_seeds(ids: np.ndarray, base: int, run: int, step: int, stream: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(np.uint64(seed_key(base, run, step, stream)) ^ ids.astype(np.uint64) * np.uint64(GAMMA))


class Xoshiro:
    """xoshiro256** generators, one for each seed, advanced together."""

    def __init__(self, seeds: np.ndarray):
        self.s, x = [], seeds.astype(np.uint64)
        with np.errstate(over="ignore"):
            for _ in range(4):
                self.s.append(splitmix(x))
                x = x + np.uint64(GAMMA)

    def next(self, who: np.ndarray | None = None) -> np.ndarray:
        """The next number of each generator, or of those chosen by a mask (others stay)."""
        rot = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
        a, b, c, d = self.s
        with np.errstate(over="ignore"):
            out = rot(b * np.uint64(5), 7) * np.uint64(9)
            t = b << np.uint64(17)
            c, d = c ^ a, d ^ b
            b, a = b ^ c, a ^ d
            c, d = c ^ t, rot(d, 45)
        new = [a, b, c, d]
        self.s = new if who is None else [np.where(who, n, o) for n, o in zip(new, self.s, strict=True)]
        return out

    def in_range(self, low: int, high: int) -> np.ndarray:
        """A number in low..high from each generator; numbers past the last whole range are drawn again."""
        n = np.uint64(high - low + 1)
        limit = np.uint64(MASK - MASK % int(n))
        out = self.next()
        again = out >= limit
        while again.any():
            out = np.where(again, self.next(again), out)
            again = out >= limit
        return (np.uint64(low) + out % n).astype(np.int64)


def assign(total: int, base: int, stream: int) -> Callable[[Column], Column]:
    """A column function: each entity's uniform choice among 0..total - 1."""

    @F.pandas_udf("long")
    def choose(ids: pd.Series) -> pd.Series:
        return pd.Series(Xoshiro(entity_seeds(ids.to_numpy(), base, 0, 0, stream)).in_range(0, total - 1))

    return choose


def distinct_draws(count: int, total: int, base: int, stream: int) -> Callable[[Column], Column]:
    """A column function: ``count`` different numbers of 0..total - 1 other than the entity's own id,
    in the order first drawn."""

    @F.pandas_udf("array<long>")
    def draw(ids: pd.Series) -> pd.Series:
        out = []
        for i, x in zip(ids.tolist(), entity_seeds(ids.to_numpy(), base, 0, 0, stream), strict=True):
            found: dict[int, None] = {}
            x = int(x)
            while len(found) < min(count, total - (0 <= i < total)):
                x = (x + GAMMA) & MASK
                z = ((x ^ x >> 30) * MIX_1) & MASK
                z = ((z ^ z >> 27) * MIX_2) & MASK
                k = (z ^ z >> 31) % total
                if k != i:
                    found[k] = None
            out.append(list(found))
        return pd.Series(out)

    return draw
