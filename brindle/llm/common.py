"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import shared_dir, written
from brindle.functions.shipping import ship

#: A word is a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Rows of an Arrow batch that Python works on at a time.
ROWS_AT_ONCE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors
    and gives the planner the true size. For tables that a result still reads; others go to a
    Scratch."""
    return written(df, shared_dir(df.sparkSession, name))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows, so that a worker holds few texts and results at a time."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def each_text(docs: DataFrame, fn: Callable[[list[str]], dict[str, pa.Array | list]], schema: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(the id, as it stands) + what fn makes of each Arrow batch of whole texts (null: empty), by
    the columns of schema. Ids never pass through pandas, where a null makes them floats."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = fn(["" if t is None else t for t in b.column(1).to_pylist()])
            columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_column, *names])

    return docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text).alias("_text")).mapInArrow(run, f"{id_column} long, {schema}")


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def n_words(text: Column) -> Column:
    """Words of a text as BIGINT; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
