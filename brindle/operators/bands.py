"""Band joins: pairs of rows with equal keys whose numbers lie within a width of each other.

Rows are put in bins as wide as the band, so partners lie in the same or a neighbouring bin: one
side keeps its bin, the other probes the bins around it, and the join is one of equal keys and bins
(a hash or merge join, never a nested loop). Where many rows of both sides meet in a bin, both are
cut into slices of HOT rows, and each slice of one side meets each of the other in a join group of
its own, so no task gets a hot bin whole and every pair is still compared once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.skew import grid, slices

#: Rows of a side that meet in one join group.
HOT = 4096


def _sliced(probes: DataFrame, bins: DataFrame, keys: list[str], hot: int) -> tuple[DataFrame, DataFrame]:
    """Both sides + _left and _right: a row keeps one slice of its own side and takes all of the other's."""
    counts = lambda df, name: df.groupBy(*keys, "_bin").agg(F.count("*").alias(name))
    full = counts(probes, "_l").where(F.col("_l") > hot).join(counts(bins, "_r").where(F.col("_r") > hot), [*keys, "_bin"])
    full = full.select(*keys, "_bin", slices("_l", hot).alias("_ls"), slices("_r", hot).alias("_rs"))
    luck = F.xxhash64("_row")
    return grid(probes.withColumn("_luck", luck), bins.withColumn("_luck", luck), [*keys, "_bin"], full)


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, width: float | int, reach: tuple[int, ...], names: tuple[str, str], hot: int) -> DataFrame:
    if width < 0:
        raise ValueError("a band's width is 0 or more")
    step = width or 1
    as_key = [f"_key{i}" for i in range(len(keys))]

    def side(df: DataFrame, column: str, place: str) -> DataFrame:
        whole = F.struct("*").alias("_row")
        found = df.where(F.col(column).isNotNull()).select(whole, *[F.col(k).alias(a) for k, a in zip(keys, as_key, strict=True)], F.col(column).alias(place))
        return found.withColumn("_bin", F.floor(F.col(place) / F.lit(step)) if isinstance(step, float) else F.expr(f"cast(floor({place} / {step}) as bigint)") if "double" in dict(df.dtypes)[column] else F.expr(f"({place} - pmod({place}, {step})) div {step}"))

    probes = side(left, x, "_x").withColumn("_bin", F.explode(F.array(*[F.col("_bin") + i for i in reach])))
    probes, bins = _sliced(probes, side(right, y, "_y"), as_key, hot)
    probes, bins = probes.withColumnRenamed("_row", names[0]), bins.withColumnRenamed("_row", names[1])
    return probes.join(bins, [*as_key, "_bin", "_left", "_right"]).where(F.abs(F.col("_x") - F.col("_y")) <= F.lit(width))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, width: float | int, names: tuple[str, str] = ("left", "right"), hot: int = HOT) -> DataFrame:
    """(left struct, right struct) of rows with equal keys and |x - y| <= width. Rows with a null key
    or number have no partner; repeated rows are paired each. x and y are whole numbers or doubles."""
    return _pairs(left, right, keys, x, y, width, (-1, 0, 1), names, hot).select(*names)


def near_pairs(df: DataFrame, keys: list[str], x: str, ids: list[str], width: float | int, names: tuple[str, str] = ("a", "b"), hot: int = HOT) -> DataFrame:
    """(a struct, b struct) of two rows of one table with equal keys and numbers within the width,
    each pair once: a comes first by (x, ids), and ids tell rows apart."""
    found = _pairs(df, df, keys, x, x, width, (0, 1), names, hot)
    place = lambda n: F.struct(f"{n}.{x}", *[f"{n}.{i}" for i in ids])
    return found.where(place(names[0]) < place(names[1])).select(*names)
