"""Sharing whole units: proportional with largest remainders, and first come first served.

A group may hold any share of all rows: sums come from grouping and a null-safe join, ranks and
running sums from one prefix scan of the table in order of (group, order), less where each group
begins; so no window and no task holds a group. Rows without a group are a group of their own;
null weights, requests, totals and capacities count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scratch import shared_dir, written
from brindle.operators.ordering import numbered


def _with(df: DataFrame, per_group: DataFrame, group: str) -> DataFrame:
    """df + the columns of a table with one row for each group."""
    other = per_group.withColumnRenamed(group, "_group")
    return df.join(other, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _keep(df: DataFrame, name: str) -> DataFrame:
    return written(df, shared_dir(df.sparkSession, name))


def _whole(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("long")


def largest_remainder(df: DataFrame, group: str, weight: str, total: str, ties: list[str], out: str = "share") -> DataFrame:
    """+ out: each row's part of its group's ``total``, in proportion to ``weight``.

    A row gets the floor of total * weight / sum of weights, at most its weight; the units left go,
    one each, to the largest remainders among rows not yet served in full, ties in order of
    ``ties``. Products are DECIMAL(38,0), exact for amounts below 2^62.
    """
    columns = df.columns
    rows = df.withColumns({"_weight": _whole(weight), "_total": _whole(total)})
    rows = _with(rows, rows.groupBy(group).agg(F.sum("_weight").alias("_sum")), group)
    rows = rows.withColumn("_product", (F.col("_total").cast("decimal(19,0)") * F.col("_weight").cast("decimal(19,0)")).cast("decimal(38,0)"))
    rows = rows.withColumn("_floor", F.when(F.col("_sum") > 0, F.expr("least(cast(_product div _sum as bigint), _weight)")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("_rest", F.when((F.col("_sum") > 0) & (F.col("_floor") < F.col("_weight")), F.expr("cast(_product % _sum as decimal(38,0))"))).drop("_product")
    # larger remainders come first, rows without one last
    placed = numbered(rows, [F.col(group).asc(), F.desc_nulls_last("_rest"), *ties], _keep, "_place")
    placed = _with(placed, placed.groupBy(group).agg(F.min("_place").alias("_first"), F.sum("_floor").alias("_given")), group)
    more = F.col("_rest").isNotNull() & (F.col("_place") - F.col("_first") < F.least("_total", "_sum") - F.col("_given"))
    return placed.select(*columns, (F.col("_floor") + more.cast("long")).alias(out))


def capped_running(df: DataFrame, group: str, asked: str, capacity: str, order: list[str | Column], out: str = "granted") -> DataFrame:
    """+ out: rows of a group are served in order, in full, until its capacity is used up."""
    columns = df.columns
    rows = numbered(df.withColumn("_asked", _whole(asked)), [F.col(group).asc(), *order], _keep, "_place", {"_before": "_asked"})
    rows = _with(rows, rows.groupBy(group).agg(F.min("_before").alias("_first")), group)
    left = _whole(capacity).cast("decimal(38,0)") - (F.col("_before") - F.col("_first"))
    return rows.select(*columns, F.greatest(F.lit(0), F.least(F.col("_asked"), left)).cast("long").alias(out))


def oracle_largest_remainder(source: str, group: str, weight: str, total: str, ties: str, out: str = "share") -> str:
    return f"""SELECT * EXCLUDE (_sum, _floor, _rest, _left, _nth), _floor + (_rest IS NOT NULL AND _nth <= _left)::BIGINT AS {out} FROM (
  SELECT *, least(coalesce({total}, 0), _sum) - sum(_floor) OVER (PARTITION BY {group}) AS _left,
    row_number() OVER (PARTITION BY {group} ORDER BY _rest DESC NULLS LAST, {ties}) AS _nth FROM (
  SELECT *, CASE WHEN _sum > 0 AND _floor < coalesce({weight}, 0) THEN coalesce({total}, 0)::HUGEINT * {weight} % _sum END AS _rest FROM (
  SELECT *, CASE WHEN _sum > 0 THEN least(coalesce({total}, 0)::HUGEINT * coalesce({weight}, 0) // _sum, coalesce({weight}, 0))::BIGINT ELSE 0 END AS _floor FROM (
  SELECT *, (coalesce(sum({weight}) OVER (PARTITION BY {group}), 0))::HUGEINT AS _sum FROM ({source}) z1) z2) z3) z4) z5"""


def oracle_capped_running(source: str, group: str, asked: str, capacity: str, order: str, out: str = "granted") -> str:
    running = f"coalesce(sum({asked}) OVER (PARTITION BY {group} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"SELECT *, greatest(0, least(coalesce({asked}, 0), coalesce({capacity}, 0) - {running}))::BIGINT AS {out} FROM ({source}) z"
