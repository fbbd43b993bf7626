"""Sharing a nation's capacity among its customers' orders, on all orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import allocation
from brindle.plans.registry import register

#: A request for each order; a nation can serve 40 % of what its customers ask for.
REQUESTS = """SELECT o_orderkey AS order_id, c_nationkey AS nation, o_totalprice::BIGINT AS asked,
  (sum(o_totalprice::BIGINT) OVER (PARTITION BY c_nationkey) * 2 // 5)::BIGINT AS capacity FROM orders JOIN customer ON o_custkey = c_custkey"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    asked = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    asked = asked.select(F.col("o_orderkey").alias("order_id"), F.col("c_nationkey").alias("nation"), F.rint("o_totalprice").cast("long").alias("asked"))
    room = asked.groupBy("nation").agg(F.expr("sum(asked) * 2 div 5").alias("capacity"))
    return asked.join(room, "nation")


@register("alloc_largest_remainder", f"SELECT order_id, nation, asked, share FROM ({allocation.oracle_largest_remainder(REQUESTS, 'nation', 'asked', 'capacity', 'order_id')}) a")
def alloc_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.largest_remainder(requests(spark, sf_dir), "nation", "asked", "capacity", ["order_id"]).select("order_id", "nation", "asked", "share")


@register("alloc_capped_running", f"SELECT order_id, nation, asked, granted FROM ({allocation.oracle_capped_running(REQUESTS, 'nation', 'asked', 'capacity', 'order_id')}) a")
def alloc_capped_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.capped_running(requests(spark, sf_dir), "nation", "asked", "capacity", ["order_id"]).select("order_id", "nation", "asked", "granted")
