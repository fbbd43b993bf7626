"""Motifs among customers that had the same part shipped in the same four weeks: all lines and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch, shared_dir, written
from brindle.operators import graph, random_graph
from brindle.plans.registry import register

SALES = """SELECT DISTINCT o_custkey AS c, l_partkey AS p, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) // 28 AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
EDGES = f"""SELECT DISTINCT a.c AS src, b.c AS dst FROM ({SALES}) a JOIN ({SALES}) b ON a.p = b.p AND a.w = b.w WHERE a.c <> b.c"""


#: Patterns outside the built-in ones; the last two have parts of their own.
OWN = {
    "house": "01 12 23 30 04 14",
    "bowtie": "01 02 12 03 04 34",
    "two_edges": "01 23",
    "edge_and_triangle": "01 02 12 34",
}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges in both directions, written once for all that a query does with them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.expr("datediff(l_shipdate, date'1970-01-01') div 28").alias("w"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("src"))
    sales = lines.join(orders, "o").select("src", "p", "w").distinct()
    pairs = sales.join(sales.withColumnRenamed("src", "dst"), ["p", "w"]).where("src <> dst").select("src", "dst").distinct()
    return written(pairs, shared_dir(spark, "edges"))


for _name in graph.MOTIFS:
    register(f"motif_{_name}", graph.oracle_count(graph.motif(_name), EDGES))(lambda spark, d, n=_name: graph.count_motif(edges(spark, d), n))
for _name, _edges in OWN.items():
    register(f"motif_{_name}", graph.oracle_count(graph.pattern(_name, _edges), EDGES))(lambda spark, d, m=graph.pattern(_name, _edges): graph.count_pattern(edges(spark, d), m))


@register("graph_normalize", f"SELECT src, dst FROM ({EDGES}) t")
def graph_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.normalize(edges(spark, sf_dir).where("src < dst"))


@register("graph_degree", f"SELECT src AS vertex, count(*) AS degree FROM ({EDGES}) t GROUP BY src")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir)).withColumnRenamed("src", "vertex")


@register(
    "graph_neighbours",
    f"SELECT src AS vertex, dst // {graph.BLOCK} AS block, array_to_string(list_sort(list(dst)), ',') AS neighbours, count(*) AS n FROM ({EDGES}) t GROUP BY 1, 2",
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir)).withColumn("neighbours", F.array_join("neighbours", ","))


@register(
    "graph_has_edge",
    f"WITH e AS ({EDGES}) SELECT c_custkey AS src, c_custkey + 1 AS dst, e.src IS NOT NULL AS linked FROM customer LEFT JOIN e ON e.src = c_custkey AND e.dst = c_custkey + 1",
)
def graph_has_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer is linked with the next."""
    pairs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    return graph.has_edge(pairs, edges(spark, sf_dir))


TRIANGLES = f"""WITH e AS MATERIALIZED ({EDGES}),
t AS (SELECT a.src AS v0, a.dst AS v1, b.dst AS v2 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst
  WHERE a.src < a.dst AND b.src < b.dst)"""


@register("motif_embeddings_triangle", f"{TRIANGLES} SELECT v0, v1, v2 FROM t")
def motif_embeddings_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(edges(spark, sf_dir))


@register("motif_per_vertex_triangle", f"{TRIANGLES} SELECT vertex, count(*) AS triangles FROM (SELECT unnest([v0, v1, v2]) AS vertex FROM t) GROUP BY vertex")
def motif_per_vertex_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.triangles(edges(spark, sf_dir))
    return found.select(F.explode(F.array("v0", "v1", "v2")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("triangles"))


@register(
    "motif_embeddings_square",
    f"""WITH e AS MATERIALIZED ({EDGES})
SELECT a.src AS v0, a.dst AS v1, b.dst AS v2, d.src AS v3 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst JOIN e d ON d.src = c.dst AND d.dst = a.src
WHERE a.src < a.dst AND a.src < b.dst AND a.src < d.src AND a.dst < d.src AND a.dst <> d.src AND b.dst <> a.src""",
)
def motif_embeddings_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every square, by the intersections that serve any connected pattern."""
    return graph.embeddings(edges(spark, sf_dir), graph.motif("square"))


#: Edges of a random graph's vertex on average.
DEGREE = 8


@register("motif_hash_gnp")
def motif_hash_gnp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random graph over all customers, DEGREE edges at each on average. SQL can't skip pairs."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    p = min(1.0, DEGREE / max(1, customers.count() - 1))
    with Scratch(spark, "gnp") as keep:
        return written(random_graph.gnp(customers, "c_custkey", p, 1, keep), shared_dir(spark, "gnp"))
