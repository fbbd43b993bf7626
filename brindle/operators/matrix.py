"""Matrix products over (row, column, value) tables, and in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import hash64
from brindle.functions.shipping import ship
from brindle.operators.skew import grid, heavy_keys, slices

#: Fixed value: the seed of the right factor differs from the left one's by this.
RIGHT_SEED = 0x9E3779B9


def parts_of(total: int, parts: int, i: int) -> tuple[int, int]:
    """(start, size) of part i of a balanced split: the first total % parts get one more."""
    size, more = divmod(total, parts)
    return i * size + min(i, more), size + (i < more)


def validate(m: int, k: int, n: int, px: int = 1, py: int = 1, square: bool = False) -> None:
    if min(m, k, n, px, py) <= 0:
        raise ValueError("sizes and grid shape must be positive")
    if square and px != py:
        raise ValueError("the ring schedule needs a square grid")


def hashed(cells: DataFrame, row: str, col: str, seed: int, out: str = "h") -> DataFrame:
    """+ out: the 64-bit hash of a cell."""
    return hash64.coordinate_hash(cells, out, seed, [(row, hash64.GAMMA), (col, hash64.MIX_1)])


def ones() -> Column:
    return F.lit(1.0)


def identity(row: str, col: str) -> Column:
    return (F.col(row) == F.col(col)).cast("double")


def deterministic(row: str, col: str, rows: int | Column, cols: int | Column) -> Column:
    """(row * cols + col) / (rows * cols), with 64-bit products."""
    r, c = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (rows, cols))
    return (F.col(row) * c + F.col(col)).cast("double") / (r * c).cast("double")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(i, k, v) times b(k, j, v): c(i, j, v), by an equi-join on k and partial sums."""
    right = b.select("k", "j", F.col("v").alias("_w"))
    return a.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def checksum(c: DataFrame) -> DataFrame:
    return c.agg(F.sum("v").alias("checksum"))


def checksum_by_margins(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of the product's cells without the product: column sums of a times row sums of b."""
    left, right = a.groupBy("k").agg(F.sum("v").alias("x")), b.groupBy("k").agg(F.sum("v").alias("y"))
    return left.join(right, "k").agg(F.sum(F.col("x") * F.col("y")).alias("checksum"))


#: Cells that a factor may have to be sent whole to each task.
SMALL = 1 << 16


def multiply_small(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same product with a right factor of few cells: it goes to each task, and a's cells
    are dealt by row, once, so that a row's products are added up where they are made."""
    right = F.broadcast(b.select("k", "j", F.col("v").alias("_w")))
    met = a.join(F.broadcast(b.select("k").distinct()), "k", "left_semi").repartition("i").join(right, "k")
    return met.groupBy("i", "j").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def multiply_heavy(a: DataFrame, b: DataFrame, share: float = 0.01, hot: int = 50_000, small: int = 0) -> DataFrame:
    """The same product where some k hold many cells. A right factor of ``small`` cells or fewer goes to
    all tasks. Else a sketch of either side finds these k in one pass, their cells are cut into slices of
    ``hot`` that meet in join groups of their own, and all other k take the plain join. The result
    is the same whatever the sketch finds."""
    if small and b.limit(small + 1).count() <= small:
        return multiply_small(a, b)
    of = lambda df, name: heavy_keys(df, "k", share).withColumnRenamed("n", name)
    full = of(a, "_l").join(of(b, "_r"), "k", "full").select("k", slices("coalesce(_l, 0)", hot).alias("_ls"), slices("coalesce(_r, 0)", hot).alias("_rs"))
    left, right = grid(a.select("i", "k", "v", F.xxhash64("i").alias("_luck")), b.select("k", "j", F.col("v").alias("_w"), F.xxhash64("j").alias("_luck")), ["k"], full)
    return left.join(right, ["k", "_left", "_right"]).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


#: Cells that a worker packs at a time.
PACKED = 1 << 16


def packed(cells: DataFrame, row: str, col: str, size: int) -> DataFrame:
    """(row block, column block, at, v): cells packed by block, in parts that add up; at and v are
    bytes of 32-bit places in the block and of doubles. Nothing is shuffled."""
    ship(cells.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            r, c, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            order = np.lexsort((c // size, r // size))
            r, c, v = r[order], c[order], v[order]
            blocks = np.stack([r // size, c // size])
            edges = np.flatnonzero(np.concatenate([[True], (blocks[:, 1:] != blocks[:, :-1]).any(axis=0)]))
            at = (r % size * size + c % size).astype(np.int32)
            ends = [*edges[1:].tolist(), len(r)]
            parts = list(zip(edges.tolist(), ends, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks[0, edges]), pa.array(blocks[1, edges]), pa.array([at[x:y].tobytes() for x, y in parts], pa.binary()), pa.array([v[x:y].tobytes() for x, y in parts], pa.binary())],
                names=[f"b{row}", f"b{col}", "at", "v"],
            )

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= PACKED:
                yield out()
                held = []
        if held:
            yield out()

    slim = cells.select(F.col(row).cast("long"), F.col(col).cast("long"), F.col("v").cast("double"))
    return slim.mapInArrow(run, f"b{row} long, b{col} long, at binary, v binary")


def multiply_blocks(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """The same product for dense operands: blocks of size by size travel packed, once, to the task
    that owns a result block; there the panels along k come in order and are multiplied and added
    up in place, so nothing of the result is shuffled. Numbers are 0 or more; a task holds three
    blocks, and each block of a is sent once for each column of blocks of b, and the other way."""
    validate(size, size, size)
    ship(a.sparkSession)
    across = lambda df, c: (df.agg(F.max(c)).first()[0] or 0) // size
    rows, cols = across(a, "i"), across(b, "j")
    left = packed(a, "i", "k", size).withColumn("bj", F.explode(F.sequence(F.lit(0), F.lit(cols)))).withColumn("side", F.lit(0))
    right = packed(b, "k", "j", size).withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(rows)))).withColumn("side", F.lit(1))
    order = ["bi", "bj", "bk", "side"]
    panels = left.select(*order, "at", "v").unionByName(right.select(*order, "at", "v")).repartition("bi", "bj").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, panel = None, None
        sides, result = np.zeros((2, size * size)), np.zeros((size, size))

        def add() -> None:
            np.add(result, sides[0].reshape(size, size) @ sides[1].reshape(size, size), out=result)
            sides[:] = 0

        def out() -> pa.RecordBatch:
            i, j = np.nonzero(result)
            cells = [pa.array(key[0] * size + i), pa.array(key[1] * size + j), pa.array(result[i, j])]
            result[:] = 0
            return pa.RecordBatch.from_arrays(cells, names=["i", "j", "v"])

        for batch in batches:
            for bi, bj, bk, side, at, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bi, bj, bk) != panel:
                    if panel is not None:
                        add()
                    panel = (bi, bj, bk)
                if (bi, bj) != key:
                    if key is not None:
                        yield out()
                    key = (bi, bj)
                np.add.at(sides[side], np.frombuffer(at, np.int32), np.frombuffer(v))
        if key is not None:
            add()
            yield out()

    return panels.mapInArrow(run, "i long, j long, v double")
