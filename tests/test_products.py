"""Products in blocks and with heavy keys, and the sketch that finds these, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import matrix, skew


def cells(rng: random.Random, rows: int, cols: int, n: int, names: str) -> list[tuple]:
    return sorted({(rng.randrange(rows), rng.randrange(cols)): rng.randrange(1, 9) for _ in range(n)}.items())


def as_table(spark, found: list, names: str):
    return spark.createDataFrame([(r, c, v) for (r, c), v in found], names)


def plain(a: list, b: list) -> dict:
    out: Counter = Counter()
    for (i, k), x in a:
        for (m, j), y in b:
            if k == m:
                out[i, j] += x * y
    return dict(out)


@pytest.mark.parametrize("size", [1, 7, 32])
def test_blocks_in_place(spark, size):
    rng = random.Random(size)
    a, b = cells(rng, 50, 40, 600, "ik"), cells(rng, 40, 30, 500, "kj")
    got = matrix.multiply_blocks(as_table(spark, a, "i long, k long, v long").repartition(5), as_table(spark, b, "k long, j long, v long").repartition(3), size)
    assert {(r["i"], r["j"]): r["v"] for r in got.collect()} == plain(a, b)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_blocks_of_nothing(spark):
    a, b = spark.createDataFrame([], "i long, k long, v double"), spark.createDataFrame([(0, 0, 1.0)], "k long, j long, v double")
    assert matrix.multiply_blocks(a, b, 4).count() == 0
    with pytest.raises(ValueError, match="positive"):
        matrix.multiply_blocks(b.withColumnRenamed("k", "i").withColumnRenamed("j", "k"), b, 0)


def test_sizes_are_checked():
    matrix.validate(3, 4, 5, 2, 2, square=True)
    for bad in ((0, 1, 1), (1, -1, 1), (1, 1, 1, 0, 1)):
        with pytest.raises(ValueError, match="positive"):
            matrix.validate(*bad)
    with pytest.raises(ValueError, match="square"):
        matrix.validate(1, 1, 1, 2, 3, square=True)


def test_sketch_counters():
    rng = np.random.default_rng(1)
    stream = np.concatenate([np.full(3000, 7), rng.integers(100, 4000, 7000)])
    rng.shuffle(stream)
    counts: dict = {}
    for x in stream.tolist():
        counts[x] = counts.get(x, 0) + 1
        counts = skew.taken_off(counts, 20)
    assert len(counts) <= 20 and 3000 - 10_000 / 20 <= counts[7] <= 3000


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_heavy_keys_are_found(spark, parts):
    rng = random.Random(3)
    keys = [1] * 3000 + [2] * 700 + [None] * 500 + [rng.randrange(10, 5000) for _ in range(5800)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(parts)
    got = {r["key"]: r["n"] for r in skew.heavy_keys(df, "key", 0.05, counters=100).collect()}
    rows = len(keys) - 500
    assert {1, 2} <= set(got) and all(keys.count(k) - rows / 100 <= n <= keys.count(k) for k, n in got.items())
    assert all(keys.count(k) >= 0.04 * rows for k in got)
    assert skew.heavy_keys(df.limit(0), "key", 0.05, 100).count() == 0
    with pytest.raises(ValueError, match="heavy"):
        skew.heavy_keys(df, "key", 0.001, 100)


def test_product_with_a_heavy_key(spark):
    """A k with over a third of all cells on either side: no join group gets it whole."""
    rng = random.Random(5)
    a = [((i, 0), rng.randrange(1, 9)) for i in range(400)] + [((i, rng.randrange(1, 200)), 2) for i in range(400, 1000)]
    b = [((0, j), rng.randrange(1, 9)) for j in range(150)] + [((rng.randrange(1, 200), j), 3) for j in range(150, 400)]
    a, b = sorted(dict(a).items()), sorted(dict(b).items())
    left, right = as_table(spark, a, "i long, k long, v long"), as_table(spark, b, "k long, j long, v long")
    got = matrix.multiply_heavy(left, right, share=0.05, hot=50)
    assert {(r["i"], r["j"]): r["v"] for r in got.collect()} == plain(a, b)
    full = skew.heavy_keys(left, "k", 0.05).select("k", skew.slices("n", 50).alias("_ls"), F.lit(3).alias("_rs"))
    x, y = skew.grid(left.withColumn("_luck", F.xxhash64("i")), right.withColumn("_luck", F.xxhash64("j")), ["k"], full)
    groups = x.groupBy("k", "_left", "_right").count().where("k = 0").collect()
    assert len(groups) == 24 and max(r["count"] for r in groups) < 2 * 50 and y.where("k = 0").count() == 150 * 8


def test_product_with_a_small_factor_deals_cells_and_not_products(spark):
    """Twelve products of each cell were dealt by place; now the cells are, by row, if the right factor is small."""
    a = [((i, k), i + k) for i in range(300) for k in range(3)]
    b = [((k, j), k * j + 1) for k in range(1, 4) for j in range(12)]
    left, right = as_table(spark, a, "i long, k long, v long"), as_table(spark, b, "k long, j long, v long")
    for small, dealt in ((36, False), (35, True)):
        got = matrix.multiply_heavy(left, right, share=0.05, hot=50, small=small)
        assert {(r["i"], r["j"]): r["v"] for r in got.collect()} == plain(a, b)
        assert bool(re.search(r"hashpartitioning\(i#\d+L, j#\d+L", got._jdf.queryExecution().executedPlan().toString())) == dealt
