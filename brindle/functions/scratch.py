"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session without one, as in
    tests, gets a folder of its own; elsewhere executors could not read it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="brindle-"))
    return spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI) that driver and executors share."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables of one job: ``keep(df, name)`` writes df and reads it back, which cuts
    lineage, survives lost executors and gives the planner true sizes. Leaving the block deletes
    the tables, so what the job returns must be written outside of it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n, self.tables = spark, shared_dir(spark, name), 0, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        delete(self.spark, self.folder)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return written(df, f"{self.folder}/{self.n:03d}-{name}")

    def bucketed(self, df: DataFrame, name: str, column: str, n: int) -> DataFrame:
        """df as a table of n buckets by column, which later joins and groups by it read without
        a shuffle; df should come hash-partitioned into n parts by column, so that each is a file."""
        self.n += 1
        self.tables.append(f"scratch_{uuid.uuid4().hex}")
        df.write.bucketBy(n, column).sortBy(column).option("path", f"{self.folder}/{self.n:03d}-{name}").saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, whatever its scheme."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
