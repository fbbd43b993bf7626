"""The global order of a whole table: row numbers, running sums, balanced contiguous parts, owners.

A prefix scan: rows are ranged and sorted by a total order, each partition is summed up, and the
sums of the partitions before are added to what is counted inside. No window spans the table; the
driver gets one row for each partition.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A partition's number stands above this many bits of the place in it.
_BITS = 33


def numbered(df: DataFrame, order: list[str | Column], keep: Callable[[DataFrame, str], DataFrame], position: str = "position", sums: dict[str, str] | None = None) -> DataFrame:
    """df in ascending ``order`` (nulls first), + position (from 0 over the whole table) and, for
    each (name, column) of ``sums``, the whole-number column's sum over the rows before, a
    DECIMAL(38,0) (nulls add nothing).

    Equal keys stay in one partition, so the order should be total; a table that ``keep`` writes
    holds the sorted rows, which fixes the numbers whatever is recomputed later.
    """
    sums = sums or {}
    at = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("_part", F.shiftright("_at", _BITS))
    parts = at.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(f"_of_{n}") for n, c in sums.items()])
    before, rows = [0] * (1 + len(sums)), []
    for r in sorted(parts.collect()):
        rows.append((r[0], *before))
        before = [b + int(x) for b, x in zip(before, r[1:], strict=True)]
    schema = ", ".join(["_part long", "_rows_before long", *[f"_before_{n} decimal(38,0)" for n in sums]])
    offsets = df.sparkSession.createDataFrame([(r[0], r[1], *map(Decimal, r[2:])) for r in rows], schema)
    out = at.join(offsets, "_part").withColumn(position, F.col("_rows_before") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for n, c in sums.items():
        out = out.withColumn(n, (F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("decimal(38,0)"))
    return out.select(*df.columns, position, *sums)


def part_of(position: str | Column, total: int, parts: int) -> Column:
    """The part of a row number when total rows are cut into contiguous parts, the first
    total % parts of which get one row more."""
    if parts < 1:
        raise ValueError("at least one part is needed")
    p = F.col(position) if isinstance(position, str) else position
    size, more = divmod(total, parts)
    edge = F.lit(more * (size + 1)).cast("long")
    large = F.expr("bigint(0)") + F.floor(p / F.lit(size + 1))
    return F.when(p < edge, large).otherwise(F.lit(more) + F.floor((p - edge) / F.lit(max(size, 1)))).cast("long")


def start_of(part: int, total: int, parts: int) -> tuple[int, int]:
    """(first row number, rows) of a part: the inverse of part_of."""
    size, more = divmod(total, parts)
    return part * size + min(part, more), size + (part < more)


def split(df: DataFrame, order: list[str], parts: int, keep: Callable[[DataFrame, str], DataFrame], out: str = "part") -> DataFrame:
    """+ out: contiguous parts of ``order`` with equal numbers of rows."""
    rows = numbered(df, order, keep, "_position")
    return rows.withColumn(out, part_of("_position", df.count(), parts)).drop("_position")


def split_by_weight(df: DataFrame, order: list[str], weight: str, parts: int, keep: Callable[[DataFrame, str], DataFrame], out: str = "part") -> DataFrame:
    """+ out: contiguous parts of ``order`` of equal weight: a row goes where the weight before it
    lies, floor(before * parts / all). Weights are whole numbers of 0 or more, null as 0."""
    if parts < 1:
        raise ValueError("at least one part is needed")
    rows = numbered(df, order, keep, "_position", {"_before": weight})
    total = int(df.agg(F.sum(weight)).first()[0] or 0)
    share = F.expr(f"cast(cast(_before as decimal(20,0)) * {parts} div {max(total, 1)} as bigint)")
    return rows.withColumn(out, F.least(share, F.lit(parts - 1).cast("long"))).drop("_position", "_before")


def bounds(parted: DataFrame, key: str, part: str = "part") -> DataFrame:
    """(part, first, last, rows) of parts by an ascending key."""
    return parted.groupBy(part).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))


def owner(df: DataFrame, key: str, known: DataFrame, out: str = "owner") -> DataFrame:
    """df + out: the part whose range holds ``key``, null below the first; by binary search in the
    bounds (the driver gets one row for each part)."""
    rows = sorted((r["first"], r["part"]) for r in known.select("part", "first").where("first is not null").collect())
    if not rows:
        return df.withColumn(out, F.lit(None).cast("long"))
    firsts, parts = F.array(*[F.lit(f) for f, _ in rows]), F.array(*[F.lit(p) for _, p in rows])
    # low is the last bound known to be at or below the key, 0 for none; high the first one above
    state = F.struct(F.lit(0).alias("low"), F.lit(len(rows) + 1).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = (s["high"] - s["low"] > 1) & (F.element_at(firsts, F.greatest(middle, F.lit(1))) <= F.col(key))
        narrower = s["high"] - s["low"] > 1
        return F.struct(F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(narrower & ~below, middle).otherwise(s["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(rows).bit_length() + 1)), state, step)["low"]
    return df.withColumn(out, F.when(F.col(key).isNotNull() & (found > 0), F.element_at(parts, F.greatest(found, F.lit(1)))).cast("long"))
