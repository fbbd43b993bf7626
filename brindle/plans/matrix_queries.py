"""Matrix products with sizes and values from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import hash64
from brindle.operators import exact_sums, matrix
from brindle.plans.registry import register

SEED = 1
RIGHT = SEED ^ matrix.RIGHT_SEED
#: A is suppliers x parts (quantities sold), B is parts x months (lines shipped).
A_SQL = "SELECT l_suppkey AS i, l_partkey AS k, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1, 2"
B_SQL = "SELECT l_partkey AS k, month(l_shipdate)::BIGINT AS j, count(*) AS v FROM lineitem GROUP BY 1, 2"
#: Dense operands: one row per supplier, one column per nation, over k = part sizes in use.
L_CELLS = "SELECT s_suppkey AS i, k FROM supplier, (SELECT DISTINCT p_size::BIGINT AS k FROM part)"
R_CELLS = "SELECT k, n_nationkey::BIGINT AS j FROM (SELECT DISTINCT p_size::BIGINT AS k FROM part), nation"


def _payload(row: str, col: str, seed: int) -> str:
    return f"({hash64.d_finish(hash64.d_keyed(seed, [(row, hash64.GAMMA), (col, hash64.MIX_1)]))} >> 44)::BIGINT"


def sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = lines.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    b = lines.groupBy(F.col("l_partkey").alias("k"), F.month("l_shipdate").cast("long").alias("j")).agg(F.count("*").alias("v"))
    return a, b


def cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The dense operands' cells: each supplier and nation takes the list of part sizes (50 at most)."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("long").alias("k")).distinct().agg(F.collect_list("k").alias("ks"))
    left = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("i")).join(F.broadcast(sizes))
    right = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("j")).join(F.broadcast(sizes))
    return left.select("i", F.explode("ks").alias("k")), right.select(F.explode("ks").alias("k"), "j")


def dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left, right = cells(spark, sf_dir)
    a = matrix.hashed(left, "i", "k", SEED).select("i", "k", F.expr("shiftrightunsigned(h, 44)").alias("v"))
    b = matrix.hashed(right, "k", "j", RIGHT).select("k", "j", F.expr("shiftrightunsigned(h, 44)").alias("v"))
    return a, b


@register("dgemm_sparse", f"WITH a AS ({A_SQL}), b AS ({B_SQL}) SELECT i, j, sum(a.v * b.v)::BIGINT AS v FROM a JOIN b USING (k) GROUP BY i, j")
def dgemm_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.multiply(*sparse(spark, sf_dir))


@register("dgemm_checksum", f"WITH a AS ({A_SQL}), b AS ({B_SQL}) SELECT sum(a.v * b.v)::BIGINT AS checksum FROM a JOIN b USING (k)")
def dgemm_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.checksum_by_margins(*sparse(spark, sf_dir))


@register("dgemm_hash_source", f"SELECT i, k, {_payload('i', 'k', SEED)} AS payload FROM ({L_CELLS}) t")
def dgemm_hash_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir)[0].withColumnRenamed("v", "payload")


@register(
    "dgemm_hash_value",
    f"SELECT i, k, ({hash64.d_finish(hash64.d_keyed(SEED, [('i', hash64.GAMMA), ('k', hash64.MIX_1)]))} >> 11)::DOUBLE * {2.0**-53!r}::DOUBLE AS v FROM ({L_CELLS}) t",
)
def dgemm_hash_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.hashed(cells(spark, sf_dir)[0], "i", "k", SEED).select("i", "k", hash64.unit("h").alias("v"))


DENSE_SQL = f"""WITH a AS (SELECT i, k, {_payload('i', 'k', SEED)} AS v FROM ({L_CELLS}) t), b AS (SELECT k, j, {_payload('k', 'j', RIGHT)} AS v FROM ({R_CELLS}) t)
SELECT i, j, sum(a.v * b.v)::BIGINT AS v FROM a JOIN b USING (k) GROUP BY i, j"""


#: Few k, each with a large share of the cells: orders by return flag, and return flag by month.
H_A_SQL = "SELECT l_orderkey AS i, ascii(l_returnflag)::BIGINT AS k, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1, 2"
H_B_SQL = "SELECT ascii(l_returnflag)::BIGINT AS k, month(l_shipdate)::BIGINT AS j, count(*) AS v FROM lineitem GROUP BY 1, 2"


@register("dgemm_heavy", f"WITH a AS ({H_A_SQL}), b AS ({H_B_SQL}) SELECT i, j, sum(a.v * b.v)::BIGINT AS v FROM a JOIN b USING (k) GROUP BY i, j")
def dgemm_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.ascii("l_returnflag").cast("long").alias("k")
    a = lines.groupBy(F.col("l_orderkey").alias("i"), k).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    b = lines.groupBy(k, F.month("l_shipdate").cast("long").alias("j")).agg(F.count("*").alias("v"))
    return matrix.multiply_heavy(a, b, small=matrix.SMALL)


@register("dgemm_hash", DENSE_SQL)
def dgemm_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.multiply(*dense(spark, sf_dir))


@register("dgemm_blocks", DENSE_SQL)
def dgemm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of 20-bit payloads stay exact in doubles."""
    return matrix.multiply_blocks(*dense(spark, sf_dir), 32).select("i", "j", F.col("v").cast("long").alias("v"))


@register("dgemm_ones", f"SELECT i, j, count(*)::DOUBLE AS v FROM ({L_CELLS}) a JOIN ({R_CELLS}) b USING (k) GROUP BY i, j")
def dgemm_ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = cells(spark, sf_dir)
    return matrix.multiply(left.withColumn("v", matrix.ones()), right.withColumn("v", matrix.ones()))


@register(
    "dgemm_identity",
    f"SELECT i, j, sum((i = k)::INT * (k = j)::INT)::DOUBLE AS v FROM ({L_CELLS}) a JOIN ({R_CELLS}) b USING (k) GROUP BY i, j",
)
def dgemm_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = cells(spark, sf_dir)
    return matrix.multiply(left.withColumn("v", matrix.identity("i", "k")), right.withColumn("v", matrix.identity("k", "j")))


@register(
    "dgemm_deterministic",
    f"SELECT i, k, (i * 64 + k)::DOUBLE / ((SELECT count(*) FROM supplier) * 64)::DOUBLE AS v FROM ({L_CELLS}) t",
)
def dgemm_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.count("*").alias("rows"))
    left = cells(spark, sf_dir)[0].join(F.broadcast(rows))
    return left.select("i", "k", matrix.deterministic("i", "k", F.col("rows"), 64).alias("v"))


@register(
    "sum_exact",
    "SELECT l_returnflag AS flag, sum((l_extendedprice * 8796093022208::DOUBLE)::HUGEINT)::DOUBLE / 8796093022208::DOUBLE AS total FROM lineitem GROUP BY 1",
)
def sum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all lines summed up exactly and rounded once: the same for any partitioning."""
    return exact_sums.exact_sum(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), ["flag"], "l_extendedprice")
