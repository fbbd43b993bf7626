"""Heat on the grid of orders: 16 x 16 cells a layer, as many layers as orders fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import hash64
from brindle.operators import heat
from brindle.plans.registry import register

SEED, ALPHA, BETA, STEPS = 7, 0.4, 0.1, 3
CELLS = "SELECT o_orderkey % 16 AS x, o_orderkey // 16 % 16 AS y, o_orderkey // 256 AS z, o_totalprice AS t FROM orders"
_HASH = hash64.d_finish(hash64.d_keyed(SEED, [("x", hash64.GAMMA), ("y", hash64.MIX_1), ("z", hash64.MIX_2)]))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey % 16 as x", "o_orderkey div 16 % 16 as y", "o_orderkey div 256 as z", "o_totalprice as t")


@register("heat_init", f"SELECT x, y, z, 0.0::DOUBLE + {_HASH}::DOUBLE / 18446744073709551615::DOUBLE * 1.0::DOUBLE AS t FROM ({CELLS}) c")
def heat_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.initial(cells(spark, sf_dir), SEED)


@register("heat_step", f"WITH {heat.oracle_steps(CELLS, 1, ALPHA, BETA)} SELECT * FROM h1")
def heat_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.step(cells(spark, sf_dir), ALPHA, BETA)


@register("heat_steps", f"WITH {heat.oracle_steps(CELLS, STEPS, ALPHA, BETA)} SELECT * FROM h{STEPS}")
def heat_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.run(cells(spark, sf_dir), STEPS, ALPHA, BETA)


@register("heat_checksum", f"WITH {heat.oracle_steps(CELLS, STEPS, ALPHA, BETA)} SELECT round(sum(t) / 1000.0, 0)::BIGINT AS checksum_thousands FROM h{STEPS}")
def heat_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In thousands: the last digits of a parallel sum depend on its order."""
    return heat.checksum(heat.run(cells(spark, sf_dir), STEPS, ALPHA, BETA)).select(F.round(F.col("checksum") / 1000.0, 0).cast("long").alias("checksum_thousands"))
