"""Text sources and sinks: files written to the shared folder and read back, and parsed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import shared_dir
from brindle.operators import graph
from brindle.plans import graph_queries
from brindle.plans.registry import register
from brindle.sources import text


@register("edge_parse", f"SELECT src, dst FROM ({graph_queries.EDGES}) t")
def edge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in a file among comments, blanks and names: parsed and normalised."""
    path = shared_dir(spark, "edge-list")
    text.write_edges(graph_queries.edges(spark, sf_dir), path)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    noise = parts.select(F.explode(F.array(F.concat(F.lit("# "), "p_partkey", F.lit(" 1")), F.concat(F.lit("% "), "p_partkey", F.lit(" 2")), F.concat(F.lit("x"), "p_partkey", F.lit(" y")), F.concat("p_partkey", F.lit("\t"), "p_partkey", F.lit(" loop")), F.lit("  "))).alias("value"))
    noise.write.mode("append").text(path)
    return graph.normalize(text.read_edges(spark, path))


@register(
    "batch_runs",
    """SELECT 'star' || (1 + c_nationkey % 4) AS motif, c_nationkey::INT AS vertices, CASE WHEN c_custkey % 2 = 0 THEN 0.25 ELSE 0.0 END AS edge_prob,
  (c_custkey % 1000)::INT AS seed, 'in,' || c_name || '.txt' AS input, c_mktsegment IN ('BUILDING', 'MACHINERY') AS debug, CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE 3 END::INT AS runs FROM customer""",
)
def batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch file with a run for each customer, a header and comments, read back."""
    path = shared_dir(spark, "batch")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    runs = F.when(F.col("c_custkey") % 3 == 0, ",7").otherwise("")
    flag = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), " Yes").otherwise("no")
    line = F.concat(F.lit("star"), 1 + F.col("c_nationkey") % 4, F.lit(","), "c_nationkey", F.lit(","), F.when(F.col("c_custkey") % 2 == 0, "0.25").otherwise(""), F.lit(", "), F.col("c_custkey") % 1000, F.lit(',"in,'), "c_name", F.lit('.txt",'), flag, runs)
    c.select(F.explode(F.array(F.concat(F.lit("# run of "), "c_name"), line)).alias("value")).write.text(path)
    spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lit("motif,vertices,edge_prob,seed,input,debug,runs").alias("value")).write.mode("append").text(path)
    return text.read_batch(spark, path)


_COUNTED = ("path3", "path4", "triangle", "star3")


@register(
    "motif_result_file",
    " UNION ALL ".join(
        f"""SELECT 'spark' AS implementation, motif, (SELECT count(*) FROM customer)::INT AS vertices, 0.0 AS edge_prob, 1 AS seed, edges, raw_embeddings, automorphisms::INT AS automorphisms, instances AS instance_count,
  'OK' AS status, 'spark_' || motif || '_Fcustomer_N1' AS logfile FROM ({graph.oracle_count(graph.motif(m), graph_queries.EDGES)}) t"""
        for m in _COUNTED
    ),
)
def motif_result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all sixteen columns, appended to a result file and read back (times and processes, which differ from run to run, left out)."""
    edges, path = graph_queries.edges(spark, sf_dir), shared_dir(spark, "results")
    vertices = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.count("*").cast("int").alias("vertices"))
    for i, m in enumerate(_COUNTED):
        found = graph.count_motif(edges, m).withColumnRenamed("instances", "instance_count").withColumn("automorphisms", F.col("automorphisms").cast("int")).join(vertices)  # one row each
        known = {"implementation": F.lit("spark"), "edge_prob": F.lit(0.0), "seed": F.lit(1), "total_processes": F.lit(1), "nodes_used": F.lit(1), "processes_per_node": F.lit(1), "search_time_ms": F.lit(0.0), "total_wall_time_ms": F.lit(0.0), "status": text.run_status(F.lit(3), F.lit(3))}
        found = found.withColumns(known)
        found = found.withColumn("logfile", text.log_name(F.col("implementation"), F.col("motif"), F.col("vertices"), F.col("edge_prob"), F.col("seed"), F.col("nodes_used"), F.lit("in/customer.txt"))).select(*text.RESULT)
        # a run that is started again leaves its rows once
        for _ in range(2):
            text.append_results(found, path, "motifs", i)
    return text.results_so_far(spark, path, found).drop("total_processes", "nodes_used", "processes_per_node", "search_time_ms", "total_wall_time_ms")


@register(
    "file_stems",
    r"""SELECT page_id, regexp_replace(CASE WHEN contains(l, '.') THEN regexp_replace(l, '\.[^.]*$', '') ELSE l END, '[^A-Za-z0-9_-]', '_', 'g') AS stem, coalesce(regexp_extract(url, 'page=([0-9]+)', 1) = '1', false) AS flag
FROM (SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS l FROM pages) t""",
)
def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of each page's address and its page number read as a flag."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    number = F.regexp_extract("url", r"page=([0-9]+)", 1)
    return pages.select("page_id", text.file_stem(F.col("url")).alias("stem"), F.coalesce(text.parse_bool(number), F.lit(False)).alias("flag"))


@register("log_metrics", r"""SELECT count(*) AS runs, round(avg(x), 3) AS average FROM (SELECT try_cast(nullif(regexp_extract(props, '"k": ?([0-9]+)', 1), '') AS DOUBLE) AS x FROM events) t WHERE x IS NOT NULL""")
def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count and the average of the numbers that the events' property texts carry."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return text.parse_metrics(events, r'"k": ?(\d+)', line="props").select("runs", F.round("average", 3).alias("average"))


@register(
    "checksum_status",
    """SELECT o_orderkey AS order_id, CASE WHEN s IS NULL THEN 'NO_CHECKSUM' WHEN abs(s - o_totalprice) <= 1e-6 + 1e-9 * abs(o_totalprice) THEN 'MATCH' ELSE 'NO_MATCH' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, sum(round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2)::DECIMAL(18,2))::DOUBLE AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""",
)
def checksum_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's price is the sum of its lines."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    price = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 2).cast("decimal(18,2)")
    sums = lines.groupBy("l_orderkey").agg(F.sum(price).cast("double").alias("s"))
    return orders.join(sums, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("order_id"), text.match_status(F.col("s"), F.col("o_totalprice")).alias("status"))


@register("run_status", """SELECT o_custkey AS customer, CASE WHEN done >= n THEN 'OK' WHEN done > 0 THEN 'PARTIAL_FAIL' ELSE 'FAIL' END AS status FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1) t""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by how many of their orders are finished."""
    by = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return by.select("customer", text.run_status(F.col("done"), F.col("n")).alias("status"))


@register("run_names", """SELECT o_orderkey AS order_id, 'spark_' || o_orderstatus || '_V' || o_custkey || '_p0.25_s' || (o_orderkey % 7) || '_N4' AS name, strftime(o_orderdate, '%Y%m%d%H%M%S') || '000' AS stamp FROM orders""")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of runs by their parameters, and times as digits, for each order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = text.log_name(F.lit("spark"), F.col("o_orderstatus"), F.col("o_custkey"), F.lit(0.25), F.col("o_orderkey") % 7, F.lit(4), F.lit(""))
    return o.select(F.col("o_orderkey").alias("order_id"), name.alias("name"), text.timestamp_text(F.col("o_orderdate")).alias("stamp"))
