"""Bounded bitmaps of 64-bit keys: they let some keys through that aren't in the set, and never
hold one back that is. They thin out candidates ahead of an exact step; what they hold is bounded
whatever the input's size, so on very large sets they only thin out less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at most (16 MB) and bits for each key.
MOST_BITS = 27
BITS_PER_KEY = 16

# Odd multipliers of 64-bit mixing.
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, well mixed, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for each ordered pair of keys."""
    return mixed((a + _M3) * _M1 ^ b)


def size_for(n: int, per_key: int = BITS_PER_KEY, most: int = MOST_BITS) -> int:
    """Binary logarithm of the places for n keys."""
    return max(10, min(most, (n * per_key).bit_length()))


def bitmap(keys: DataFrame, column: str) -> np.ndarray | None:
    """The bitmap of a BIGINT column; None for an empty table. The driver gets its words, 2^21 at most."""
    n = keys.count()
    if not n:
        return None
    b = size_for(n)
    at = F.shiftrightunsigned(column, 64 - b)
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - b}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (b - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the bitmap's set."""
    at = keys >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def thinned(rows: DataFrame, columns: list[str], keys: DataFrame, like: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows whose columns may equal those named like of keys (all that do, few others), and the rest.
    The words of a bitmap are broadcast, 2^21 at most, so that wide rows needn't be shuffled to find
    the few that a join is about; all in built-in functions, nulls equal nulls."""
    b = size_for(keys.count())

    def place(names: list[str]) -> tuple[Column, Column]:
        at = F.shiftrightunsigned(F.xxhash64(*names), 64 - b)
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))

    word, bit = place(like)
    words = F.broadcast(keys.select(word.alias("_bitmap_word"), bit.alias("_bitmap_bit")).groupBy("_bitmap_word").agg(F.bit_or("_bitmap_bit").alias("_bitmap_bits")))
    word, bit = place(columns)
    same = (word == F.col("_bitmap_word")) & (bit.bitwiseAND(F.col("_bitmap_bits")) != 0)
    return rows.join(words, same, "left_semi"), rows.join(words, same, "left_anti")
