"""Sums of doubles that are exact until the last rounding, so the same for any partitioning.

A double is a whole number times a power of two. Each is split into a bin of 2^BIN exponents and a
whole number of units of that bin, which fits a DECIMAL(38,0) with room for 10^11 rows; bins are
added up exactly, partly before the shuffle, and there are 68 of them at most. The bins of a group
meet in one row, where the sum is rounded once, as math.fsum rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.shipping import ship

#: Binary logarithm of the exponents that share a bin.
BIN = 32
#: A finite double is a multiple of 2^LOWEST.
LOWEST = -1074


def _power(e: str) -> str:
    """SQL for 2^e, e from -1022 to 1023."""
    return f"pow(2D, {e})"


def units(x: str) -> tuple[Column, Column]:
    """(bin, whole number) of a finite double column, x = number * 2^(LOWEST + BIN * bin)."""
    # log2 may be one off: 54 below it there is still nothing of the number left out
    e = f"greatest(cast(floor(log2(abs({x}))) as int) - 54, {LOWEST})"
    at = f"(({e}) - {LOWEST}) div {BIN}"
    # scaled in two steps, each power within range; the whole number is below 2^56
    half = f"cast(-({e}) div 2 as int)"
    whole = f"cast(({x} * {_power(half)}) * {_power(f'(-({e}) - {half})')} as bigint)"
    more = f"shiftleft(1L, cast(({e}) - {LOWEST} - {BIN} * ({at}) as int))"
    return F.expr(f"cast(if({x} = 0, 0, {at}) as int)"), F.expr(f"if({x} = 0, cast(0 as decimal(38,0)), cast(cast({whole} as decimal(20,0)) * cast({more} as decimal(11,0)) as decimal(38,0)))")


def rounded(bins: list[tuple[int, int]]) -> float:
    """The sum of number * 2^(LOWEST + BIN * bin), rounded to the nearest double."""
    try:
        return float(sum((Fraction(n) * Fraction(2) ** (LOWEST + BIN * b) for b, n in bins), Fraction(0)))
    except OverflowError:
        return float("inf") if sum(n << BIN * b for b, n in bins) > 0 else float("-inf")


def exact_sum(df: DataFrame, keys: list[str], column: str, out: str = "total") -> DataFrame:
    """keys + out: the sum of a double column in each group, rounded once. Nulls add nothing, a group
    of nulls sums to 0; NaN and infinities give what adding them gives."""
    ship(df.sparkSession)
    b, n = units("_x")
    rows = df.select(*keys, F.col(column).cast("double").alias("_x"))
    odd = F.col("_x").isNull() | F.isnan("_x") | (F.abs("_x") == float("inf"))
    rows = rows.select(*keys, F.when(odd, F.lit(-1)).otherwise(b).alias("_bin"), F.when(odd, F.lit(0).cast("decimal(38,0)")).otherwise(n).alias("_n"), F.when(odd, F.col("_x")).alias("_odd"))
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"), F.sum("_odd").alias("_odd"))
    sums = bins.groupBy(*keys).agg(F.collect_list(F.struct("_bin", F.col("_n").cast("string").alias("n"))).alias("_bins"), F.sum("_odd").alias("_odd"))

    @F.pandas_udf("double")
    def finish(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([rounded([(int(x["_bin"]), int(x["n"])) for x in row if x["_bin"] >= 0]) for row in s], dtype="float64")

    return sums.select(*keys, F.coalesce("_odd", finish("_bins")).alias(out))
