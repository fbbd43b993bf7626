"""Random graphs G(n, p) over a table's ids, in work that follows the edges and not the pairs.

Ids are numbered in order. The triangle of pairs u < v is cut into square tiles of some EDGES
expected edges each; inside a tile the distance from one edge to the next is drawn (geometric
gaps), so pairs without an edge cost nothing. The draws are hashes of (seed, tile, nth draw): the
graph is the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.hash64 import GAMMA, MASK, MIX_1, MIX_2
from brindle.functions.scratch import Scratch
from brindle.functions.shipping import ship
from brindle.operators.ordering import numbered

#: Edges that a tile has on average, at most.
EDGES = 4096


def check(n: int, p: float) -> None:
    if n <= 0:
        raise ValueError("a graph needs at least one vertex")
    if not 0 <= p <= 1:
        raise ValueError("an edge's probability lies between 0 and 1")


def side_of(p: float, edges: int = EDGES) -> int:
    """Ids along a tile's side."""
    return max(1, isqrt(int(edges / p))) if p > 0 else 1 << 31


def tile_at(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column), row <= column, of the k-th tile, column by column."""
    col = ((np.sqrt(8.0 * k + 1) - 1) / 2).astype(np.int64)
    col -= col * (col + 1) // 2 > k
    col += (col + 1) * (col + 2) // 2 <= k
    return k - col * (col + 1) // 2, col


def uniforms(key: int, first: int, n: int) -> np.ndarray:
    """n doubles in (0, 1] of a key, from the ``first`` on: SplitMix64's stream."""
    with np.errstate(over="ignore"):
        z = np.uint64(key) + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def tile_key(seed: int, row: int, col: int) -> int:
    return (seed * MIX_2 ^ row * MIX_1 ^ col * GAMMA) & MASK


def places(key: int, cells: int, p: float) -> np.ndarray:
    """The ascending places among ``cells`` where a tile has an edge."""
    if p <= 0 or cells <= 0:
        return np.zeros(0, np.int64)
    if p >= 1:
        return np.arange(cells)
    out, last, drawn, scale = [], -1, 0, log1p(-p)
    while last < cells:
        n = int((cells - last) * p * 1.1) + 16
        # a gap beyond the tile ends it, whatever its size
        gaps = np.minimum(np.floor(np.log(uniforms(key, drawn, n)) / scale), float(cells)).astype(np.int64)
        at = last + np.cumsum(gaps + 1)
        out.append(at)
        last, drawn = int(at[-1]), drawn + n
    found = np.concatenate(out)
    return found[found < cells]


def tile_edges(row: int, col: int, n: int, p: float, seed: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v), u < v, of a tile's edges among the numbers 0..n - 1."""
    low_u, low_v = row * side, col * side
    high_u, high_v = min(low_u + side, n), min(low_v + side, n)
    width = high_v - low_v
    if row != col:
        at = places(tile_key(seed, row, col), (high_u - low_u) * width, p)
        return low_u + at // width, low_v + at % width
    # on the diagonal the cells are the pairs above it, column by column
    at = places(tile_key(seed, row, col), width * (width - 1) // 2, p)
    u, v = tile_at(at)
    return low_u + u, low_v + v + 1


def numbers(spark, n: int, p: float, seed: int, edges: int = EDGES) -> DataFrame:
    """(u, v), u < v, of G(n, p) on the numbers 0..n - 1."""
    check(n, p)
    ship(spark)
    side = side_of(p, edges)
    across = -(-n // side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, col in zip(*(x.tolist() for x in tile_at(b.column(0).to_numpy())), strict=True):
                u, v = tile_edges(row, col, n, p, seed, side)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return spark.range(across * (across + 1) // 2).mapInArrow(run, "u long, v long")


def gnp(ids: DataFrame, column: str, p: float, seed: int, keep: Scratch, edges: int = EDGES) -> DataFrame:
    """(src, dst) of G(n, p) on the different values of a column, nulls left out; src comes first in
    their order."""
    names = keep(numbered(ids.select(column).where(F.col(column).isNotNull()).distinct(), [column], keep, "_number"), "ids")
    found = numbers(ids.sparkSession, names.count(), p, seed, edges)
    of = lambda at, name: names.select(F.col("_number").alias(at), F.col(column).alias(name))
    return found.join(of("u", "src"), "u").join(of("v", "dst"), "v").select("src", "dst")
