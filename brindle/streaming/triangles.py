"""Triangles of a graph whose edges arrive in batches, counted as they come.

Edges seen so far are a ledger table, pointing from lower to higher id. A batch adds what it closes:
a triangle with at least one new edge is found from its new edges, through the neighbours that
both ends share, and so once for each of its k new edges; shares of 1/k are added up as counts by k.
Only neighbours of new edges' ends are touched. Edges, counts and the batch's place in the ledger
are written once, so a batch that is killed and run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch
from brindle.sources import ledger
from brindle.sources.text import parse_edges

EDGES = "a long, b long"
COUNTS = "batch long, edges long, triangles long"


def closed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row, triangles: those of old and new edges (a < b, all different) that have a new one."""
    both = old.withColumn("new", F.lit(0)).union(new.withColumn("new", F.lit(1)))
    arcs = both.union(both.select("b", "a", "new"))
    touched = new.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    near = arcs.join(touched, "a", "left_semi")
    first = new.join(near.select("a", F.col("b").alias("w"), F.col("new").alias("n1")), "a").where("w <> b")
    found = first.join(near.select(F.col("a").alias("b"), F.col("b").alias("w"), F.col("new").alias("n2")), ["b", "w"])
    by = found.groupBy((1 + F.col("n1") + F.col("n2")).alias("k")).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum(F.expr("n div k")), F.lit(0)).alias("triangles"))


def add(edges: DataFrame, batch: int, path: str, run: str = "edges") -> None:
    """Takes in a batch (src, dst); repeats, loops and edges seen before add nothing."""
    spark = edges.sparkSession
    if ledger.done(spark, f"{path}/counts", run, batch):
        return
    with Scratch(spark, "arriving") as keep:
        pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        # a rerun after its edges were written still counts against the batches before
        before = [f for f in ledger.folders(spark, f"{path}/edges") if f"/{run}-{int(batch):012d}-" not in f]
        old = spark.read.schema(EDGES).parquet(*before) if before else spark.createDataFrame([], EDGES)
        new = keep(pairs.join(old, ["a", "b"], "left_anti"), "new")
        row = closed(old, new).select(F.lit(0).alias("edges"), "triangles").union(new.agg(F.count("*"), F.lit(0))).agg(F.sum("edges").alias("edges"), F.sum("triangles").alias("triangles"))
        ledger.append_once(new, f"{path}/edges", run, batch)
        ledger.append_once(row.select(F.lit(batch).cast("long").alias("batch"), "edges", "triangles"), f"{path}/counts", run, batch)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, edges, triangles): what each batch added."""
    return ledger.read(spark, f"{path}/counts", COUNTS)


def follow(spark: SparkSession, folder: str, path: str, per_batch: int = 100):
    """A started streaming query that takes in edge-list files as they land in a folder, until all
    that are there are done."""
    edges = parse_edges(spark.readStream.option("maxFilesPerTrigger", per_batch).text(folder))
    return edges.writeStream.foreachBatch(lambda df, batch: add(df, batch, path)).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
