"""Source divergence audit: how far each source's words stray from the other sources of its language.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; each language keeps its
terms of LEAST documents or more. A group is a (lang, source); p is a term's smoothed share in a
group in units of 1/SCALE, q that of another group or of the language, and f = (p - q)^2 / q, in
whole numbers throughout.

Run-length columns: the kept vocabulary is put in order of its terms' counts in all groups (range
partitions, so no task holds a language), which brings equal counts together; a chunk of it is one
run-length column for each group, the terms that a group doesn't have being runs of count 0. A
pair of groups meets on the union of both columns' run boundaries: f is taken once for each piece
and multiplied by its length. Sums over chunks are added up in the task, so that a task gives one
row for each pair. The driver gets one row for each group; the result has the square of that.

Sums are BIGINT: f summed over a language stays below 10^18 + 10^9 V, which fits for vocabularies
of up to 8 * 10^9 terms (and raises beyond, as Spark's sums do under ANSI).

Edge cases: null text, lang and source read as ''; a text without terms still makes its group
occur; a group without terms has equal shares; a language of one source has no pairs; without kept
terms pairs get 0; repeated rows count as documents each; very long texts are used whole; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch
from brindle.functions.shipping import ship
from brindle.llm.common import saved, sliced, table

#: Documents that a term needs, units of a share, terms listed for each group.
LEAST = 3
SCALE = 1_000_000_000
TOP = 200
#: Terms of a run-length chunk; counted terms that a worker holds.
CHUNK = 65_536
HELD = 200_000
#: Parts of a group in the search for its first TOP terms.
PARTS = 16

#: A byte of a term stays (A-Z lower-cased), any other becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it, in parts."""
    ship(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (la, so), (n, d) in held.items():
            terms = list(n)
            for low in range(0, len(terms), 10_000):
                part = terms[low : low + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([la] * len(part)), pa.array([so] * len(part)), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], names=names
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in sliced(batches):
            for la, so, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, d = held.setdefault((la, so), (Counter(), Counter()))
                terms = t.translate(LETTERS).split()
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    parts = _groups(docs, lang, source, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    out = parts.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return out.withColumn("term", F.col("term").cast("string"))


def _groups(docs: DataFrame, lang: str, source: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), *more)


def vocabulary(docs: DataFrame, least: int = LEAST, **columns: str) -> DataFrame:
    """(lang, term, n, cells) of kept terms; cells has (source, n) of each source with the term."""
    by_group = counted(docs, **columns).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_group.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return kept.where(F.col("docs") >= least).drop("docs")


def groups(docs: DataFrame, vocab: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, n, v, n_lang): counts of kept terms in each group and in its language."""
    per_lang = vocab.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    per_group = vocab.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    out = _groups(docs, lang, source).distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    return out.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "n_lang")])


def share(counts: np.ndarray, of: int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / of), exactly."""
    if len(counts) and int(counts.max()) >= 1 << 33:
        return np.array([1 + SCALE * (int(c) + 1) // of for c in counts], np.int64)
    return 1 + SCALE * (counts + 1) // of


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the runs of equal numbers."""
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    return starts, column[starts]


def add_pairs(columns: list[tuple[np.ndarray, np.ndarray]], length: int, sums: np.ndarray) -> None:
    """Adds to sums[g, h] what f comes to over a chunk, columns being (starts, shares) for each group."""
    for g in range(len(columns)):
        for h in range(g + 1, len(columns)):
            (s, p), (t, q) = columns[g], columns[h]
            cuts = np.union1d(s, t)
            width = np.diff(cuts, append=length)
            p, q = p[np.searchsorted(s, cuts, "right") - 1], q[np.searchsorted(t, cuts, "right") - 1]
            square = (p - q) * (p - q)
            sums[g, h] += int((square // q * width).sum())
            sums[h, g] += int((square // p * width).sum())


def pair_sums(vocab: DataFrame, known: dict[str, dict[str, int]]) -> DataFrame:
    """(lang, source, item, value): f of each group by each other source of its language; known has
    the divisors (n + v) of every language's sources."""
    ship(vocab.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def add(lang: str, cells: pa.ListArray) -> None:
            of = known[lang]
            flat = cells.flatten()
            group = pc.index_in(flat.field("source"), pa.array(list(of), pa.string())).to_numpy()
            n, row = flat.field("n").to_numpy(), np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy())
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(len(of) + 1))
            columns = []
            for g, d in enumerate(of.values()):
                mine, column = order[edges[g] : edges[g + 1]], np.zeros(len(cells), np.int64)
                column[row[mine]] = n[mine]
                starts, values = runs(column)
                columns.append((starts, share(values, d)))
            add_pairs(columns, len(cells), sums.setdefault(lang, np.zeros((len(of), len(of)), np.int64)))

        held, lang, size = [], None, 0
        for b in batches:
            starts, names = runs(np.array(b.column(0).to_pylist(), object))
            for low, high, name in zip(starts, [*starts[1:], b.num_rows], names, strict=True):
                if held and (name != lang or size >= CHUNK):
                    add(lang, pa.concat_arrays(held))
                    held, size = [], 0
                held, lang, size = [*held, b.column(1).slice(low, high - low)], name, size + high - low
        if held:
            add(lang, pa.concat_arrays(held))
        for lang, m in sums.items():
            names = list(known[lang])
            for g, name in enumerate(names):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array([name] * len(names)), pa.array(names), pa.array(m[g])], names=["lang", "source", "item", "value"])

    ordered = vocab.repartitionByRange("lang", "cells", "term").sortWithinPartitions("lang", "cells", "term").select("lang", "cells")
    parts = ordered.mapInArrow(run, "lang string, source string, item string, value long").where("source <> item")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: str, of: str) -> Column:
    return F.expr(f"1 + {SCALE}BD * (cast({n} as decimal(20,0)) + 1) div cast({of} as decimal(20,0))")


def term_values(vocab: DataFrame, stats: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value): terms with a larger share in the group than in its language,
    the first ``top`` of each group in each of PARTS parts, and so the first of the group."""
    cells = vocab.select("lang", "term", F.col("n").alias("all"), F.explode("cells").alias("c")).select("lang", "c.source", "term", "all", "c.n")
    both = cells.join(stats.withColumnRenamed("n", "of"), ["lang", "source"]).withColumn("p", _share("n", "of + v")).withColumn("q", _share("all", "n_lang + v"))
    out = both.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    part = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(PARTS))).orderBy(F.desc("value"), "item")
    return out.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= top).drop("nth")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has all other sources of the language,
    part ``term`` the terms that speak most for the group. Written to the shared folder."""
    names = {k: v for k, v in columns.items() if k in ("lang", "source")}
    with Scratch(docs.sparkSession, "divergence") as keep:
        vocab = keep(vocabulary(docs, least, **columns), "vocabulary")
        stats = keep(groups(docs, vocab, **names), "groups")
        known: dict[str, dict[str, int]] = {}
        for r in sorted(stats.collect()):
            known.setdefault(r["lang"], {})[r["source"]] = r["n"] + r["v"]
        one, other = stats.select("lang", "source"), stats.select("lang", F.col("source").alias("item"))
        pairs = one.join(other, "lang").where("source <> item").join(pair_sums(vocab, known), ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        terms = term_values(vocab, stats, top).select("lang", "source", F.lit("term").alias("part"), "item", "value")
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        return saved(pairs.unionByName(terms).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)), "divergence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def oracle() -> str:
    upper = "".join(map(chr, range(65, 91)))
    p = f"1 + {SCALE}::HUGEINT * (n + 1) // (total + v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
f AS (SELECT lang, source, term, n, {p} AS p FROM (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, s.total, v.v FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term)),
q AS (SELECT lang, term, {p} AS q FROM k JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source WHERE a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM f JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u) WHERE part = 'pair' OR rank <= {TOP}"""
