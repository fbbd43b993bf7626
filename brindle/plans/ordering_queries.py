"""Balanced contiguous parts of whole tables, and which part owns a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch, shared_dir, written
from brindle.operators import ordering
from brindle.plans.registry import register

PARTS = 12
ORDERS = f"""SELECT o_orderkey, least(before * {PARTS} // total, {PARTS - 1})::BIGINT AS part FROM (
  SELECT o_orderkey, coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, (sum(n) OVER ())::HUGEINT AS total
  FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) c) s"""


def _orders_by_lines(spark: SparkSession, sf_dir: str, keep: Scratch) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").join(lines, "o_orderkey", "left")
    return ordering.split_by_weight(orders, ["o_orderkey"], "n", PARTS, keep).select("o_orderkey", "part")


@register("split_orders_by_lines", ORDERS)
def split_orders_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in key order, cut into parts of equal numbers of lines."""
    with Scratch(spark, "split") as keep:
        return written(_orders_by_lines(spark, sf_dir, keep), shared_dir(spark, "split"))


@register("split_owner", f"SELECT l_orderkey, l_linenumber, part AS owner FROM lineitem JOIN ({ORDERS}) p ON o_orderkey = l_orderkey")
def split_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that owns each line's order, from the bounds of the parts alone."""
    with Scratch(spark, "owner") as keep:
        known = written(ordering.bounds(_orders_by_lines(spark, sf_dir, keep), "o_orderkey"), shared_dir(spark, "bounds"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return ordering.owner(lines, "l_orderkey", known)


@register(
    "split_rows",
    f"""SELECT part, count(*) AS rows, min(c_custkey) AS first, max(c_custkey) AS last FROM (
  SELECT c_custkey, CASE WHEN r < more * (size + 1) THEN r // (size + 1) ELSE more + (r - more * (size + 1)) // greatest(size, 1) END AS part FROM (
  SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () // {PARTS} AS size, count(*) OVER () % {PARTS} AS more FROM customer) a) b GROUP BY part""",
)
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers cut into parts of equal numbers of rows: size and bounds of each."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    with Scratch(spark, "split") as keep:
        return written(ordering.bounds(ordering.split(customers, ["c_custkey"], PARTS, keep), "c_custkey"), shared_dir(spark, "split-rows")).select("part", "rows", "first", "last")


@register(
    "running_price",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position,
  coalesce(sum((o_totalprice * 100)::BIGINT) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cents_before FROM orders""",
)
def running_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's place in time and what all orders before it came to."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_orderkey", F.rint(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    with Scratch(spark, "running") as keep:
        return written(ordering.numbered(orders, ["o_orderdate", "o_orderkey"], keep, sums={"cents_before": "cents"}).select("o_orderkey", "position", F.col("cents_before").cast("long")), shared_dir(spark, "running"))
