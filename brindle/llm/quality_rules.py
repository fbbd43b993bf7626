"""Quality rules: one threshold table, compiled into one projection of built-in functions.

Edge cases: a null or empty text has no words, fails the base rule and is not kept; very long
texts are judged whole; repeated rows are judged row by row; an empty table gives an empty result;
input columns are dropped unless named in ``carry`` (a carried column whose name clashes with a
result gives way).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import WORD, table

#: Frequent function words of the corpus languages, lower case.
STOP_WORDS = (
    "the of and to a in is it that for was on are as with be by an at from this or not"
    " der die das und ist in den von zu mit sich des auf für nicht ein eine als auch dem"
    " le la les de des et un une du en est que qui dans pour par sur au pas plus"
    " el los las y que del se por con para una su al lo como es"
).split()


#: Fixed value: what is trimmed off a word before it is looked up among the stop words.
EDGES = ".,;:!?()[]*#$%&|<>-_\""

#: Columns that the rules make.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "base_failed", "failed_rules", "kept")


class Rule(NamedTuple):
    """Keep a text when low <= metric <= high; metric is SQL over the statistics columns."""

    name: str
    metric: str
    low: float
    high: float


#: The threshold table; ratios are per word or per line with a word.
RULES = (
    Rule("length", "n_words", 20, 10_000_000),
    Rule("word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / n_words", 0.0, 0.2),
    Rule("stop_words", "n_stop_words / n_words", 0.02, 1.0),
    Rule("duplicate_lines", "n_dup_lines / n_lines", 0.0, 0.5),
)


def statistics(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words of every whole text.

    Repeated windows are found inside each row: the 8-word windows are hashed to 64 bits; only
    rows where a hash recurs go on to sort (hash, position) pairs, and there the words decide.
    """
    w, blank = "regexp_extract_all(_text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)", r"[^\x20\x09-\x0D]"
    stop = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    kept = [c for c in carry if c not in RESULTS]
    # carried columns travel in a struct, where no name of theirs can clash
    out = df.select(F.struct(*[F.col(c) for c in kept]).alias("_carried") if kept else F.lit(0).alias("_carried"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = out.withColumn("_words", F.expr(w)).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(blank))
    )
    out = out.select(
        "_carried",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast(size(filter(_words, x -> trim(BOTH '{EDGES}' FROM lower(x)) in ({stop}))) as bigint)").alias("n_stop_words"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_hashes"),
    )
    out = out.withColumn(
        "_windows",
        F.expr("if(n_words < 9, array(), transform(sequence(1, cast(n_words as int) - 7), i -> xxhash64(slice(_hashes, i, 8))))"),
    ).drop("_hashes")
    out = out.withColumn(
        "_sorted",
        F.expr("if(size(array_distinct(_windows)) = size(_windows), array(), array_sort(transform(_windows, (h, i) -> struct(h, i))))"),
    ).drop("_windows")
    same = "(x.h = get(_sorted, i {0} 1).h and slice(_words, x.i + 1, 8) = slice(_words, get(_sorted, i {0} 1).i + 1, 8))"
    out = out.withColumn(
        "_at",
        F.expr(f"array_sort(transform(filter(_sorted, (x, i) -> {same.format('-')} or {same.format('+')}), x -> x.i))"),
    ).drop("_sorted", "_words")
    covered = "aggregate(transform(_at, (p, i) -> least(8, coalesce(get(_at, i + 1) - p, 8))), 0L, (a, x) -> a + x)"
    out = out.withColumn("n_repeat_words", F.expr(covered))
    return out.select(*(["_carried.*"] if kept else []), *RESULTS[:7])


def verdicts(stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, failed_rules and kept; the table becomes one projection."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    safe = lambda m: f"coalesce({m.replace('/ n_words', '/ nullif(n_words, 0)').replace('/ n_lines', '/ nullif(n_lines, 0)')}, 0)"
    failed = [F.when(~F.expr(safe(r.metric)).between(r.low, r.high), F.lit(r.name)) for r in rules]
    out = stats.withColumn("base_failed", base).withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def apply_rules(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return verdicts(statistics(df, text, carry), rules)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    """DuckDB SQL for query()."""
    metric = {
        "n_words": "n_words",
        "word_chars / n_words": "word_chars / n_words",
        "n_symbols / n_words": "n_symbols / n_words",
        "n_stop_words / n_words": "n_stop_words / n_words",
        "n_dup_lines / n_lines": "n_dup_lines / n_lines",
    }
    rules = " AND ".join(f"coalesce({metric[r.metric]}, 0) BETWEEN {r.low} AND {r.high}" for r in RULES)
    stop = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM t)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
s AS (
  SELECT t.doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
    len(txt) - len(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: trim(lower(x), '{EDGES}') IN ({stop}))) AS n_stop_words
  FROM t LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {rules} AS kept
FROM b"""
