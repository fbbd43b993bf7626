"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


#: Rows of an Arrow batch at most: whole texts and arrays can be long, and both the JVM and the
#: Python worker hold a batch.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the session's executors, once, and keep Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_brindle_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="brindle-src-"), "brindle.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    sc.addPyFile(path)
    sc._brindle_shipped = True
