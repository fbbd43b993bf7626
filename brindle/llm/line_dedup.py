"""Line dedup by site-relative frequency, in DataFrame functions alone.

Rows are grouped by host. A line (text between line feeds, with at least one word) that stands on
more than ``ratio`` of a host's pages, and on ``least`` of them or more, is boilerplate of that
host and is dropped from all its pages. ``host`` names the column that groups pages into sites: a
source's name, or ``host_of`` a URL.

A host has at most (lines of a page on average) / ratio such lines, so they fit one small array
per host. Lines are counted as 96-bit hashes, once per page, with partial sums before the shuffle;
whole texts are not shuffled while the arrays are small enough for the planner to broadcast, and
beyond that a hot host's rows are split by the adaptive skew join.

Edge cases: null text stays null and an empty one empty, and both count as pages; null hosts form
one host; blank lines are kept; a text of boilerplate alone becomes empty, its row stays; repeated
rows count as pages each; an empty table gives an empty result; other columns pass unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import WORD, saved, table

#: Share of a host's pages beyond which a line is boilerplate. On sf0.1 (20 hosts) the commonest
#: line stands on 8.6 to 13.2 % of each host's pages and the next on 4.8 % at most.
RATIO = 0.065
#: A line on fewer pages repeats too little to be told from a pair of copies.
LEAST = 3


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without a port; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def boilerplate(df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(_site_host, _site_lines): hashes of each host's boilerplate lines."""
    lines = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(WORD)))
    # an entry without a line counts the page itself
    entries = F.concat(F.array(F.lit(None).cast("struct<h:bigint,g:int>")), F.transform(lines, _hash))
    counts = df.select(_host(host).alias("_site_host"), F.explode(entries).alias("_site_line")).groupBy("_site_host", "_site_line").agg(F.count("*").alias("_site_n"))
    counts = saved(counts.where((F.col("_site_n") >= least) | F.col("_site_line").isNull()), "line-counts")
    pages = counts.where("_site_line is null").select("_site_host", F.col("_site_n").alias("_site_pages"))
    found = counts.where("_site_line is not null").join(pages, "_site_host").where(F.col("_site_n") > ratio * F.col("_site_pages"))
    return found.groupBy("_site_host").agg(F.collect_set("_site_line").alias("_site_lines"))


def _cleaned(df: DataFrame, text: str, host: str, ratio: float, least: int) -> DataFrame:
    """_row (the columns of df as one struct, where no name can clash), _text, n_lines, n_dropped."""
    bad = saved(boilerplate(df, text, host, ratio, least), "line-boilerplate")
    out = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), _host(host).alias("_site_host")).join(bad, "_site_host", "left")
    out = out.withColumn("_site_split", F.split("_text", "\n", -1))
    kept = F.when(F.col("_site_lines").isNull(), F.col("_site_split")).otherwise(F.filter("_site_split", lambda x: ~(x.rlike(WORD) & F.array_contains("_site_lines", _hash(x)))))
    out = out.withColumn("_site_kept", kept)
    out = out.withColumn("n_lines", F.coalesce(F.size("_site_split"), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(F.size("_site_split") - F.size("_site_kept"), F.lit(0)).cast("long"))
    same = F.col("n_dropped") == 0
    return out.select("_row", F.when(same, F.col("_text")).otherwise(F.array_join("_site_kept", "\n")).alias("_text"), "n_lines", "n_dropped")


def drop_lines(df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """df with boilerplate lines dropped from text, + n_lines and n_dropped (columns of these names
    give way)."""
    own = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in df.columns if c not in ("n_lines", "n_dropped")]
    return _cleaned(df, text, host, ratio, least).select(*own, "n_lines", "n_dropped")


def cleaned(df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """df with boilerplate lines dropped from text; all other columns, whatever their names, pass unchanged."""
    return _cleaned(df, text, host, ratio, least).select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


def oracle() -> str:
    return f"""
WITH l AS (
  SELECT DISTINCT doc_id, coalesce('=' || source, '') AS host, line
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '{WORD}')),
pages AS (SELECT coalesce('=' || source, '') AS host, count(*) AS n FROM documents GROUP BY 1),
bad AS (
  SELECT host, line FROM l JOIN pages USING (host) GROUP BY host, line, n
  HAVING count(*) >= {LEAST} AND count(*) > {RATIO} * n),
per_host AS (SELECT host, list(line) AS bads FROM bad GROUP BY host),
s AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls, coalesce(bads, []) AS bads
  FROM documents d LEFT JOIN per_host p ON coalesce('=' || d.source, '') = p.host),
k AS (SELECT *, list_filter(ls, lambda x: NOT list_contains(bads, x)) AS kept FROM s)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_dropped
FROM k"""
