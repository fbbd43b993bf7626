"""Edges that arrive as files: degrees kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.text import parse_edges


def degree_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A streaming table (vertex, degree) over edge-list files as they land in a folder. Each file
    lists its edges once; repeats are dropped by the state."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_batch).text(folder)
    edges = parse_edges(lines).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).dropDuplicates(["a", "b"])
    return edges.select(F.explode(F.array("a", "b")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))
