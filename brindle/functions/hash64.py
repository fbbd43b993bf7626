"""Unsigned 64-bit arithmetic and mixing on BIGINT columns.

Spark has no unsigned type and, under ANSI, no wrapping product. Products and sums by a constant
are built from 16- and 32-bit limbs, so that results hold in every session; a BIGINT carries the
bit pattern of the unsigned number. Steps are columns of their own: each reads its input by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The multipliers and the increment of SplitMix64.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
MASK = (1 << 64) - 1


def signed(x: int) -> int:
    """The BIGINT with the bit pattern of an unsigned number."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def times(x: str, k: int) -> str:
    """SQL for x * k modulo 2^64."""
    k &= MASK
    b0, b1, h0, h1 = (k >> s & 0xFFFF for s in (0, 16, 32, 48))
    lo, hi = f"({x} & 4294967295L)", f"shiftrightunsigned({x}, 32)"
    low = f"({lo} * {b0}L)"
    mid = f"(shiftrightunsigned({low}, 16) + {lo} * {b1}L)"
    high = f"(shiftrightunsigned({mid}, 16) + {lo} * {h0}L + shiftleft({lo} * {h1}L & 65535L, 16) + {hi} * {b0}L + shiftleft({hi} * {b1}L & 65535L, 16))"
    return f"(shiftleft({high} & 4294967295L, 32) | shiftleft({mid} & 65535L, 16) | ({low} & 65535L))"


def plus(x: str, k: int) -> str:
    """SQL for x + k modulo 2^64."""
    k &= MASK
    low = f"(({x} & 4294967295L) + {k & 0xFFFFFFFF}L)"
    high = f"(shiftrightunsigned({x}, 32) + {k >> 32}L + shiftrightunsigned({low}, 32))"
    return f"(shiftleft({high} & 4294967295L, 32) | ({low} & 4294967295L))"


def literal(k: int) -> str:
    s = signed(k)
    return "(-9223372036854775807L - 1L)" if s == -(1 << 63) else f"{s}L"


def keyed(seed: int, parts: list[tuple[str, int]]) -> str:
    """SQL for seed ^ part * multiplier ^ ...; each part is a BIGINT column."""
    return " ^ ".join([literal(seed), *(times(c, k) for c, k in parts)])


def finish(df: DataFrame, name: str) -> DataFrame:
    """Column name put through SplitMix64's two mixing rounds and its last shift."""
    for shift, k in ((30, MIX_1), (27, MIX_2)):
        df = df.withColumn(name, F.expr(f"{name} ^ shiftrightunsigned({name}, {shift})")).withColumn(name, F.expr(times(name, k)))
    return df.withColumn(name, F.expr(f"{name} ^ shiftrightunsigned({name}, 31)"))


def splitmix(df: DataFrame, name: str) -> DataFrame:
    """Column name replaced by its SplitMix64 hash."""
    return finish(df.withColumn(name, F.expr(plus(name, GAMMA))), name)


def coordinate_hash(df: DataFrame, name: str, seed: int, parts: list[tuple[str, int]]) -> DataFrame:
    """+ name: the mixed hash of a cell's coordinates."""
    return finish(df.withColumn(name, F.expr(keyed(seed, parts))), name)


def unit(name: str) -> Column:
    """The upper 53 bits as a double in [0, 1)."""
    return F.expr(f"shiftrightunsigned({name}, 11) * {2.0**-53!r}D")


def modulo(x: str, n: str) -> str:
    """SQL for the unsigned remainder of x by a positive n below 2^31."""
    return f"((shiftrightunsigned({x}, 1) % ({n})) * 2 + ({x} & 1L)) % ({n})"


def draw(df: DataFrame, name: str, out: str, low: int, high: int) -> DataFrame:
    """+ out: a number in low..high from a mixed seed, with one retry beyond the last whole range."""
    n = high - low + 1
    limit = signed(MASK - MASK % n)
    again = f"(({name} ^ {literal(1 << 63)}) >= ({limit}L ^ {literal(1 << 63)}))" if n & (n - 1) else "false"
    x = f"if({again}, {plus(name, GAMMA)}, {name})"
    return df.withColumn(out, F.expr(x)).withColumn(out, F.expr(f"{low} + {modulo(out, str(n))}"))


def seed_key(base: int, run: int, step: int, stream: int) -> int:
    """The part of an entity's seed that is the same for all entities."""
    return (base ^ run * 0xD6E8FEB86659FD93 ^ step * MIX_1 ^ stream * MIX_2) & MASK


def entity_seed(df: DataFrame, entity: str, name: str, base: int, run: int, step: int, stream: int) -> DataFrame:
    """+ name: the mixed seed of (base, run, step, entity, stream)."""
    return splitmix(df.withColumn(name, F.expr(keyed(seed_key(base, run, step, stream), [(entity, GAMMA)]))), name)


# The same in DuckDB's SQL, for the oracles.
def d_times(x: str, k: int) -> str:
    return f"((({x})::UHUGEINT * {k & MASK}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def d_keyed(seed: int, parts: list[tuple[str, int]]) -> str:
    out = f"{seed & MASK}::UBIGINT"
    for c, k in parts:
        out = f"xor({out}, {d_times(c, k)})"
    return out


def d_finish(x: str) -> str:
    for shift, k in ((30, MIX_1), (27, MIX_2)):
        x = d_times(f"xor({x}, ({x}) >> {shift})", k)
    return f"xor({x}, ({x}) >> 31)"


def d_splitmix(x: str) -> str:
    return d_finish(f"((({x})::UHUGEINT + {GAMMA}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT")
