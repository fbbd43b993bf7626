"""Customers as agents on a grid of orders, 100 cells wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import sugar
from brindle.operators.iterate import cut
from brindle.plans.registry import register

WIDTH, STEPS = 100, 3
_H, _W = "((SELECT count(*) FROM orders) // 100)::DOUBLE", "100::DOUBLE"


def _distance(share: float) -> str:
    r, c = f"(row - h * {share}::DOUBLE)", f"(col - w * {share}::DOUBLE)"
    return f"sqrt({r} * {r} + {c} * {c})"


_CAPACITY = f"""SELECT row, col, CASE WHEN near <= radius * 0.25::DOUBLE THEN 4 WHEN near <= radius * 0.5::DOUBLE THEN 3 WHEN near <= radius * 0.75::DOUBLE THEN 2 ELSE 1 END AS capacity
FROM (SELECT row, col, least({_distance(0.25)}, {_distance(0.75)}) AS near, least(h, w) * 0.4::DOUBLE AS radius
  FROM (SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, {_H} AS h, {_W} AS w FROM orders) p) q"""
CELLS = f"SELECT row, col, capacity, capacity AS sugar FROM ({_CAPACITY}) k"
AGENTS = """SELECT c_custkey AS id, (c_custkey * 10 + c_nationkey % 10) // 100 AS row, (c_custkey * 10 + c_nationkey % 10) % 100 AS col,
  (5 + abs(c_acctbal)::BIGINT % 6)::BIGINT AS wealth, (1 + c_custkey % 4)::INT AS metabolism, (1 + c_nationkey % 6)::INT AS vision FROM customer"""
_STEP = f"WITH {sugar.oracle_steps(AGENTS, CELLS, 1)}"
_STEPS = f"WITH {sugar.oracle_steps(AGENTS, CELLS, STEPS)}"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    size = orders.agg(F.expr(f"cast(count(*) div {WIDTH} as double)").alias("h"))
    grid = orders.select(F.expr(f"o_orderkey div {WIDTH}").alias("row"), (F.col("o_orderkey") % WIDTH).alias("col")).join(F.broadcast(size))
    out = grid.withColumn("capacity", sugar.capacity(F.col("row"), F.col("col"), F.col("h"), F.lit(float(WIDTH))))
    return out.select("row", "col", "capacity", F.col("capacity").alias("sugar"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("c_custkey") * 10 + F.col("c_nationkey") % 10
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("id"),
        F.floor(at / WIDTH).alias("row"),
        (at % WIDTH).alias("col"),
        (5 + F.rint(F.abs("c_acctbal")).cast("long") % 6).alias("wealth"),
        (1 + F.col("c_custkey") % 4).cast("int").alias("metabolism"),
        (1 + F.col("c_nationkey") % 6).cast("int").alias("vision"),
    )


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents after the first step's moves."""
    a, c = agents(spark, sf_dir), cells(spark, sf_dir)
    parts = sugar.parts_for(a, c)
    return sugar.move(a, cut(sugar.targets(a, c, parts)), parts)


@register("sugar_capacity", _CAPACITY)
def sugar_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("row", "col", "capacity")


@register("sugar_agents", AGENTS)
def sugar_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents(spark, sf_dir)


@register("sugar_targets", f"{_STEP} SELECT id, row, col FROM s0")
def sugar_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sugar.targets(agents(spark, sf_dir), cells(spark, sf_dir)).select("id", "row", "col")


@register("sugar_conflicts", f"{_STEP} SELECT row, col, id FROM w0")
def sugar_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sugar.winners(sugar.targets(agents(spark, sf_dir), cells(spark, sf_dir)))


@register("sugar_moves", f"{_STEP} SELECT id, row, col, wealth FROM m0")
def sugar_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved(spark, sf_dir).select("id", "row", "col", "wealth")


@register("sugar_occupants", f"{_STEP} SELECT row, col, max(id) AS id FROM m0 GROUP BY row, col")
def sugar_occupants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sugar.occupants(moved(spark, sf_dir))


@register("sugar_regrow", f"{_STEPS} SELECT row, col, capacity, sugar FROM g1")
def sugar_regrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sugar.regrow(sugar.step(agents(spark, sf_dir), cells(spark, sf_dir), first=True)[1])


@register("sugar_step_agents", f"{_STEP} SELECT id, row, col, wealth FROM a1")
def sugar_step_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sugar.step(agents(spark, sf_dir), cells(spark, sf_dir), first=True)[0].select("id", "row", "col", "wealth")


@register("sugar_step_cells", f"{_STEP} SELECT row, col, sugar FROM c1")
def sugar_step_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sugar.step(agents(spark, sf_dir), cells(spark, sf_dir), first=True)[1].select("row", "col", "sugar")


@register("sugar_run_agents", f"{_STEPS} SELECT id, row, col, wealth FROM a{STEPS}")
def sugar_run_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sugar.run(agents(spark, sf_dir), cells(spark, sf_dir), STEPS)[0].select("id", "row", "col", "wealth")


@register(
    "sugar_run_totals",
    f"{_STEPS} SELECT count(*) AS live_agents, coalesce(sum(wealth), 0)::BIGINT AS total_wealth, (SELECT sum(sugar) FROM c{STEPS})::BIGINT AS total_sugar FROM a{STEPS}",
)
def sugar_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sugar.totals(*sugar.run(agents(spark, sf_dir), cells(spark, sf_dir), STEPS))
