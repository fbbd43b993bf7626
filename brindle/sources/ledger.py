"""Tables that grow by batches, each batch once.

A batch's rows go to a folder of their own; a small file, created only if it isn't there yet, then
names that folder for (run, batch). Readers take the folders that are named. So a batch that was
killed half way, or written twice, or run again after a restart leaves its rows once: an unnamed
folder is never read, and the first to name a batch wins.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _entry(path: str, run: str, batch: int) -> str:
    return f"{path}/ledger/{quote(run, safe='')}-{int(batch):012d}"


def done(spark: SparkSession, path: str, run: str, batch: int) -> bool:
    fs, at = _fs(spark, _entry(path, run, batch))
    return fs.exists(at)


def append_once(df: DataFrame, path: str, run: str, batch: int, form: str = "parquet", **options) -> bool:
    """Appends df as the rows of (run, batch), unless they are there; tells whether they were written.
    form and options are a writer's format and what it takes."""
    spark = df.sparkSession
    if done(spark, path, run, batch):
        return False
    folder = f"rows/{quote(run, safe='')}-{int(batch):012d}-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(f"{path}/{folder}")
    return _name(spark, path, run, batch, folder)


def _name(spark: SparkSession, path: str, run: str, batch: int, folder: str) -> bool:
    """Names a batch's folder in one step: a finished file is renamed, which fails if the name is taken."""
    fs, entry = _fs(spark, _entry(path, run, batch))
    _, draft = _fs(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    fs.mkdirs(entry.getParent())
    out = fs.create(draft)
    out.write(bytearray(folder.encode()))
    out.close()
    if not fs.exists(entry) and fs.rename(draft, entry):
        return True
    fs.delete(draft, False)
    fs.delete(_fs(spark, f"{path}/{folder}")[1], True)
    return False


def folders(spark: SparkSession, path: str) -> list[str]:
    """The named folders in order of (run, batch); the driver gets a line for each batch."""
    fs, at = _fs(spark, f"{path}/ledger")
    if not fs.exists(at):
        return []
    files = sorted(str(x.getPath()) for x in fs.listStatus(at) if re.search(r"-\d{12}$", str(x.getPath())))
    lines = {r["f"]: r["value"] for r in spark.read.text(files).selectExpr("value", "input_file_name() as f").collect()} if files else {}
    return [f"{path}/{lines[k]}" for k in sorted(lines)]


def read(spark: SparkSession, path: str, schema, form: str = "parquet", **options) -> DataFrame:
    """The rows of all named batches."""
    found = folders(spark, path)
    return spark.read.schema(schema).format(form).options(**options).load(found) if found else spark.createDataFrame([], schema)
