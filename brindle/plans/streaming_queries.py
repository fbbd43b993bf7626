"""Edges that arrive in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import shared_dir
from brindle.operators import graph
from brindle.plans import graph_queries
from brindle.plans.registry import register
from brindle.sources import text
from brindle.streaming import triangles


@register("stream_triangles", f"SELECT edges, instances AS triangles FROM ({graph.oracle_count(graph.motif('triangle'), graph_queries.EDGES)}) t")
def stream_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges as files that a stream takes in batch by batch, some of them twice."""
    folder, path = shared_dir(spark, "arriving"), shared_dir(spark, "triangles")
    edges = graph_queries.edges(spark, sf_dir)
    text.write_edges(edges.repartition(4, "src"), folder)
    edges.where("src < dst and src % 10 = 0").select(F.concat_ws("\t", "dst", "src").alias("value")).coalesce(2).write.mode("append").text(folder)
    triangles.follow(spark, folder, path, per_batch=2).awaitTermination()
    return triangles.counts(spark, path).agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))
