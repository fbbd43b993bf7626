"""Edge lists, batches of runs and result tables as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources import ledger

#: Columns of a batch file; the last is optional.
BATCH = ("motif", "vertices", "edge_prob", "seed", "input", "debug", "runs")
#: Columns of a result table.
RESULT = ("implementation", "motif", "vertices", "edge_prob", "seed", "total_processes", "nodes_used", "processes_per_node", "edges", "raw_embeddings", "automorphisms", "instance_count", "search_time_ms", "total_wall_time_ms", "status", "logfile")
_DEFAULTS = {"vertices": "0", "edge_prob": "0.0", "seed": "1", "runs": "3"}


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def parse_bool(c: Column) -> Column:
    return F.lower(trimmed(c)).isin("1", "true", "yes")


def file_stem(c: Column) -> Column:
    """A path's last part without its suffix; other characters than letters, digits, _ and - become _."""
    last = F.regexp_extract(c, r"([^/\\]*)$", 1)
    stem = F.when(last.contains("."), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)
    return F.regexp_replace(stem, r"[^A-Za-z0-9_-]", "_")


def parse_edges(lines: DataFrame, line: str = "value") -> DataFrame:
    """(src, dst) of lines with two integers; blank, ``#``, ``%`` and unparsable lines are skipped,
    further tokens ignored."""
    text = trimmed(F.col(line))
    parts = F.split(text, r"\s+")
    pairs = lines.where(~F.substring(text, 1, 1).isin("#", "%") & (text != "")).select(F.get(parts, F.lit(0)).try_cast("bigint").alias("src"), F.get(parts, F.lit(1)).try_cast("bigint").alias("dst"))
    return pairs.where("src is not null and dst is not null")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(spark.read.text(path))


def write_edges(edges: DataFrame, path: str) -> None:
    """One ``u v`` line for each undirected edge."""
    edges.where("src < dst").select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a batch file: quoted commas are kept, ``#`` lines skipped, a header line dropped."""
    raw = spark.read.csv(path, schema=", ".join(f"{c} string" for c in BATCH), comment="#", quote='"', mode="PERMISSIVE")
    raw = raw.where(trimmed(F.col("motif")) != "").where(~F.lower(trimmed(F.col("motif"))).isin("motif", "vertices"))
    value = lambda c: F.coalesce(F.nullif(trimmed(F.col(c)), F.lit("")), F.lit(_DEFAULTS.get(c)))
    return raw.select(trimmed(F.col("motif")).alias("motif"), value("vertices").cast("int").alias("vertices"), value("edge_prob").cast("double").alias("edge_prob"), value("seed").cast("int").alias("seed"), value("input").alias("input"), parse_bool(F.coalesce("debug", F.lit(""))).alias("debug"), value("runs").cast("int").alias("runs"))


def log_name(implementation: Column, motif: Column, vertices: Column, edge_prob: Column, seed: Column, nodes: Column, input_file: Column) -> Column:
    """A run's name: of its input file where it has one, else of its parameters."""
    given = F.concat(F.lit("F"), file_stem(input_file))
    made = F.concat(F.lit("V"), vertices.cast("string"), F.lit("_p"), F.regexp_replace(edge_prob.cast("decimal(10,6)").cast("string"), r"\.?0+$", ""), F.lit("_s"), seed.cast("string"))
    return F.concat_ws("_", implementation, motif, F.when(F.coalesce(input_file, F.lit("")) != "", given).otherwise(made), F.concat(F.lit("N"), nodes.cast("string")))


def timestamp_text(at: Column) -> Column:
    """A time as digits down to its milliseconds, in the session's zone."""
    return F.date_format(at, "yyyyMMddHHmmssSSS")


def run_status(completed: Column, asked: Column) -> Column:
    return F.when(completed >= asked, "OK").when(completed > 0, "PARTIAL_FAIL").otherwise("FAIL")


def write_results(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.csv(path, header=True, mode="append" if append else "errorifexists")


def read_results(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.csv(path, header=True, schema=like.schema)


def append_results(df: DataFrame, path: str, run: str, batch: int) -> bool:
    """Appends rows to a result table of CSV files, once for each (run, batch) however often it is
    run; tells whether they were written."""
    return ledger.append_once(df, path, run, batch, "csv", header=True)


def results_so_far(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return ledger.read(spark, path, like.schema, "csv", header=True)


def write_snapshot(agents: DataFrame, cells: DataFrame, prefix: str, step: int) -> None:
    """``<prefix>_<step>_GRID`` and ``_AGENT`` tables."""
    at = f"{prefix}_{step:06d}"
    write_results(cells.select("row", "col", F.col("sugar").alias("sugarCount")), f"{at}_GRID.csv")
    write_results(agents.select(F.col("id").alias("agentID"), "row", "col", "wealth", "metabolism", "vision"), f"{at}_AGENT.csv")


def parse_metrics(lines: DataFrame, pattern: str, line: str = "value", warm_up: bool = False) -> DataFrame:
    """One row: runs and the average of a log's numbers (group 1 of the pattern), the first run
    (named ``Run 0``) left out where it is a warm-up."""
    found = lines.select(F.regexp_extract(line, pattern, 1).try_cast("double").alias("x"), F.col(line).contains("Run 0").alias("first")).where("x is not null")
    if warm_up:
        found = found.where("not first")
    return found.agg(F.count("*").alias("runs"), F.avg("x").alias("average"))


def match_status(got: Column, expected: Column) -> Column:
    """MATCH where |got - expected| <= 1e-6 + 1e-9 |expected|."""
    near = F.abs(got - expected) <= F.lit(1e-6) + F.lit(1e-9) * F.abs(expected)
    return F.when(expected.isNull(), "NO_BASELINE").when(got.isNull(), "NO_CHECKSUM").when(near, "MATCH").otherwise("NO_MATCH")
