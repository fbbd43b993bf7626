"""Loops of DataFrame steps with lineage cut at intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from brindle.functions.scratch import shared_base


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that the session names."""
    spark = df.sparkSession
    base = shared_base(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], n: int, cut_every: int = 1) -> DataFrame:
    """step(state, i) for i = 0 .. n - 1, with the lineage cut after every ``cut_every`` steps."""
    for i in range(n):
        state = step(state, i)
        if cut_every and (i + 1) % cut_every == 0 and i + 1 < n:
            state = cut(state)
    return state
