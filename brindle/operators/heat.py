"""Heat on a grid: seven-point Jacobi steps with walls that no heat crosses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import hash64
from brindle.operators.iterate import iterate

#: Order in which the neighbours are added: x-, x+, y-, y+, z-, z+.
NEIGHBOURS = (("x", -1), ("x", 1), ("y", -1), ("y", 1), ("z", -1), ("z", 1))


def initial(cells: DataFrame, seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """cells(x, y, z) -> + t, a hash of the coordinates scaled to low..high."""
    h = hash64.coordinate_hash(cells.select("x", "y", "z"), "_h", seed, [("x", hash64.GAMMA), ("y", hash64.MIX_1), ("z", hash64.MIX_2)])
    unsigned = F.expr("cast(if(_h < 0, cast(_h as decimal(20,0)) + 18446744073709551616, cast(_h as decimal(20,0))) as double)")
    return h.select("x", "y", "z", (F.lit(low) + unsigned / F.lit(18446744073709551615.0) * F.lit(high - low)).alias("t"))


def step(field: DataFrame, alpha: float, beta: float) -> DataFrame:
    """One step: each cell sends its heat to its six neighbours and gathers theirs, in one shuffle;
    where a neighbour is missing its own heat stands in. The sum is taken in a fixed order."""
    sends = [F.struct("x", "y", "z", F.lit(0).alias("side"), "t")]
    for k, (axis, d) in enumerate(NEIGHBOURS, 1):
        at = [(F.col(a) - d).alias(a) if a == axis else F.col(a) for a in "xyz"]
        sends.append(F.struct(*at, F.lit(k).alias("side"), "t"))
    got = field.select(F.inline(F.array(*sends))).groupBy("x", "y", "z").agg(*[F.max(F.when(F.col("side") == k, F.col("t"))).alias(f"t{k}") for k in range(7)])
    total = F.coalesce("t1", "t0")
    for k in range(2, 7):
        total = total + F.coalesce(f"t{k}", "t0")
    return got.where("t0 is not null").select("x", "y", "z", (F.lit(alpha) * F.col("t0") + F.lit(beta) * total).alias("t"))


def run(field: DataFrame, steps: int, alpha: float, beta: float, cut_every: int = 5) -> DataFrame:
    stepper: Callable[[DataFrame, int], DataFrame] = lambda f, _: step(f, alpha, beta)
    return iterate(field, stepper, steps, cut_every)


def checksum(field: DataFrame) -> DataFrame:
    return field.agg(F.sum("t").alias("checksum"))


def oracle_steps(initial_sql: str, steps: int, alpha: float, beta: float) -> str:
    """DuckDB CTEs h0 .. h<steps>, unrolled."""
    out = [f"h0 AS ({initial_sql})"]
    for s in range(steps):
        joins, terms = [], []
        for k, (axis, d) in enumerate(NEIGHBOURS, 1):
            on = " AND ".join(f"n{k}.{a} = c.{a}{f' + {d}' if a == axis else ''}" for a in "xyz")
            joins.append(f"LEFT JOIN h{s} n{k} ON {on}")
            terms.append(f"coalesce(n{k}.t, c.t)")
        out.append(f"h{s + 1} AS (SELECT c.x, c.y, c.z, {alpha!r}::DOUBLE * c.t + {beta!r}::DOUBLE * ({' + '.join(terms)}) AS t FROM h{s} c {' '.join(joins)})")
    return ",\n".join(out)
