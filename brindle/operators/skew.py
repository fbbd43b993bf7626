"""Keys that hold many rows: found in one pass, and joined in slices.

The sketch keeps a bounded number of counters in each task (Misra and Gries: when they run over,
the same amount is taken off all); sums of tasks' counters stay sketches of the same error. A key
of more than rows / counters rows is always found, and its count is at most that much too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.shipping import ship

COUNTERS = 1024


def taken_off(counts: dict, counters: int) -> dict:
    """At most ``counters`` of the counts, what the next one has being taken off all of them."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return {k: n - off for k, n in counts.items() if n > off}


def heavy_keys(df: DataFrame, key: str, share: float, counters: int = COUNTERS) -> DataFrame:
    """(key, n): every key of a BIGINT column with at least ``share`` of the rows, and perhaps some
    with little less; n is its count or up to rows / counters less. Null keys aren't counted."""
    if not 1 / counters < share <= 1:
        raise ValueError("a heavy key's share lies above one by the number of counters")
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        rows = 0
        for b in batches:
            keys, n = np.unique(b.column(0).drop_null().to_numpy(), return_counts=True)
            rows += int(n.sum())
            for k, x in zip(keys.tolist(), n.tolist(), strict=True):
                counts[k] = counts.get(k, 0) + x
            counts = taken_off(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.int64()), pa.array([rows, *counts.values()], pa.int64())], names=["key", "n"])

    found = df.select(F.col(key).cast("long").alias("key")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # a bounded sketch: the number of rows and what is heavy are a few numbers on the driver
    rows = found.where("key is null").agg(F.sum("n")).first()[0] or 0
    return found.where(F.col("key").isNotNull() & (F.col("n") >= rows * (share - 1 / counters))).select(F.col("key").alias(key), "n")


def grid(left: DataFrame, right: DataFrame, keys: list[str], full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides + _left and _right, to be joined on as well. ``full`` has keys, _ls and _rs: into how
    many slices the rows of either side with these keys are cut. A row keeps one slice of its own
    side, by the column _luck, and takes all of the other's, so every pair meets once."""

    def cut(df: DataFrame, own: str, of: str, others: str, other: str) -> DataFrame:
        out = df.join(full, keys, "left").na.fill(1, ["_ls", "_rs"])
        out = out.withColumn(own, F.expr(f"cast(pmod(_luck, {of}) as int)"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_ls", "_rs", "_luck")

    return cut(left, "_left", "_ls", "_rs", "_right"), cut(right, "_right", "_rs", "_ls", "_left")


def slices(count: str, hot: int) -> Column:
    """How many slices of ``hot`` rows a count makes, one at least."""
    return F.expr(f"greatest(1, cast(ceil({count} / {float(hot)}D) as int))")
