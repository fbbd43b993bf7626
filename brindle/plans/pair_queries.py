"""Pairs of rows that lie near each other: all events, all lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import bands
from brindle.plans.registry import register

HOUR = 3_600_000_000
DAYS = 7


@register(
    "band_events",
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events)
SELECT a.user_id, a.event_id AS first_event, b.event_id AS second_event, b.t - a.t AS apart FROM e a JOIN e b ON a.user_id = b.user_id
WHERE (a.t < b.t OR (a.t = b.t AND a.event_id < b.event_id)) AND b.t - a.t <= {HOUR}""",
)
def band_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user within an hour of each other, in microseconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    found = bands.near_pairs(events, ["user_id"], "t", ["event_id"], HOUR)
    return found.select("a.user_id", F.col("a.event_id").alias("first_event"), F.col("b.event_id").alias("second_event"), (F.col("b.t") - F.col("a.t")).alias("apart"))


@register(
    "band_lines",
    f"""WITH l AS (SELECT l_partkey AS part, l_orderkey AS o, l_linenumber AS n, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS day, l_quantity AS q FROM lineitem)
SELECT a.part, count(*) AS pairs, max(b.day - a.day) AS widest, sum((a.q * b.q)::BIGINT)::BIGINT AS product FROM l a JOIN l b ON a.part = b.part
WHERE ((a.day, a.o, a.n) < (b.day, b.o, b.n)) AND b.day - a.day <= {DAYS} GROUP BY a.part""",
)
def band_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the pairs of lines shipped within seven days of each other."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.expr("cast(datediff(l_shipdate, date'1970-01-01') as bigint)").alias("day"), F.col("l_quantity").alias("q"))
    found = bands.near_pairs(lines, ["part"], "day", ["o", "n"], DAYS)
    return found.groupBy(F.col("a.part").alias("part")).agg(F.count("*").alias("pairs"), F.max(F.col("b.day") - F.col("a.day")).alias("widest"), F.sum((F.col("a.q") * F.col("b.q")).cast("long")).alias("product"))


@register(
    "band_orders_before",
    f"""SELECT e.event_id, count(*) AS orders FROM (SELECT event_id, user_id, epoch_us(ts) // {24 * HOUR} AS day FROM events) e
JOIN (SELECT o_custkey, epoch_us(o_orderdate) // {24 * HOUR} % 30 + 19723 AS day FROM orders) o ON o.o_custkey = e.user_id WHERE abs(e.day - o.day) <= 2 GROUP BY 1""",
)
def band_orders_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the orders of the customer of its user's number within two days, by the day of
    a 30-day cycle."""
    day = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) div {24 * HOUR}")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("who"), day("ts").alias("day"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("who"), (day("o_orderdate") % 30 + 19723).alias("at"))
    return bands.band_join(events, orders, ["who"], "day", "at", 2).groupBy(F.col("left.event_id").alias("event_id")).agg(F.count("*").alias("orders"))
