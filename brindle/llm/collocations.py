"""Phrase collocation mining by best-first branch and bound, for each language apart.

A phrase of MOST words at the most grows from its first word. All counts of a phrase's extensions
are bounded by its own, so a cut after the first word scores at most 1000 n / f(first word), and
the lowest cut counts: this is an admissible bound on all phrases that start with the word. First
words stand in bands of their counts, of STEP to one; the band of the rarest words, with the
highest bounds, is expanded first, then the next, until a language's TOP-th surviving score is above
the bound of what is left (equal scores are still looked at, as ties have an order).

The corpus is read twice: for the words' counts, and to cut texts into runs of words that occur
often enough (nothing else can be part of a candidate), stored with a 32-bit code for each word.
A band then grows level by level over the runs: pairs are counted by 64-bit keys made of codes, and
where a key is frequent triples are; bounded bitmaps hold the frequent keys. Keys that collide let
through more, never less; what is left is counted by its words. Suffixes of candidates that start
with a word of a later band are counted apart, as scores need them.

A candidate is contained in a longer one of the same count just when all its occurrences have the
same next, or the same previous word, which is noted while counting.

The bands' table is bounded too: a place of it holds the rarest band of the words that fall on it,
so that a word may be expanded early, never late. Counts go through DECIMAL(38,0): exact for up to
10^14 words. The driver gets a row for each language and the bitmaps.

Edge cases: null text counts as empty, null lang as ``und``; texts without words add nothing; a
language without candidates has no rows; repeated rows count each; very long texts are used whole;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch
from brindle.functions.shipping import ship
from brindle.llm.common import saved, sliced, table
from brindle.llm.sketches import bitmap, has, mixed, paired, size_for

LEAST = 100
MOST = 5
TOP = 2000
STEP = 64
#: Places of the bands' table, as a power of two at most.
MOST_PLACES = 24
NO_BAND = 255
#: Entries that a worker holds before it hands them on; parts of a language in the search for TOP.
HELD = 300_000
PARTS = 32

#: A-Z become a-z; what ends a piece becomes a dot, which so stands in no word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_BREAK = b"."


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, with a dot where a piece ends. Bytes split at ASCII blanks alone."""
    return text.translate(FOLD).replace(_BREAK, b" . ").split()


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def _emptied(held: dict[str, Counter], names: list[str]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        keys = list(counts)
        for low in range(0, len(keys), 10_000):
            part = keys[low : low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array([counts[k] for k in part], pa.int64())], names=names)
    held.clear()


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n); the null word counts all of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in sliced(batches):
            for lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts, words = held.setdefault(lang, Counter()), words_of(t)
                n = words.count(_BREAK)
                counts.update(words)
                counts[None] += len(words) - n
                del counts[_BREAK]
            if sum(map(len, held.values())) > HELD:
                yield from _emptied(held, ["lang", "word", "n"])
        yield from _emptied(held, ["lang", "word", "n"])

    found = texts.mapInArrow(run, "lang string, word binary, n long").withColumn("word", F.col("word").cast("string"))
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Codes(dict):
    """word of one language -> its 32-bit code, the upper half of XXH64 of both; a break is 0."""

    def __init__(self, lang: str):
        super().__init__()
        self.head = lang.encode() + b"\0"

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= HELD:
            self.clear()
        out = self[word] = 0 if word == _BREAK or not word else xxhash.xxh64_intdigest(self.head + word, 42) >> 32 or 1
        return out


def bands(words: DataFrame, least: int, step: int) -> np.ndarray:
    """Place -> the band of its rarest word; words has lang, word and n >= least."""
    b = size_for(words.count(), 8, MOST_PLACES)
    code = F.shiftrightunsigned(F.xxhash64(F.concat("lang", F.lit("\0"), "word")), 32)
    at = F.shiftrightunsigned(F.when(code == 0, F.lit(1)).otherwise(code), 32 - b)
    # whole numbers: a count of least * step begins the second band
    band = F.size(F.filter(F.array(*[F.lit(least * step**i) for i in range(1, 12) if least * step**i < 1 << 62]), lambda x: x <= F.col("n")))
    found = words.select(at.alias("at"), band.alias("band")).groupBy("at").agg(F.min("band").alias("band")).toArrow()
    out = np.full(1 << b, NO_BAND, np.uint8)
    out[found.column("at").to_numpy()] = found.column("band").to_numpy()
    return out


def _places(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Bands of the codes."""
    return np.where(codes == 0, NO_BAND, table[codes >> np.uint32(32 - (len(table).bit_length() - 1))])


def runs(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """(lang, words, codes): of each text the runs of two frequent words or more; runs are parted by
    an empty word and the code 0, which also end the row."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Codes] = {}
        for b in sliced(batches):
            out: list[tuple] = []
            for lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(t)
                code = known.setdefault(lang, Codes(lang))
                codes = np.array([code[w] for w in words] + [0], np.uint32)
                codes[_places(shared.value, codes) == NO_BAND] = 0
                before, after = np.concatenate([[0], codes[:-1]]), np.concatenate([codes[1:], [0]])
                codes[(before == 0) & (after == 0)] = 0
                keep = (codes != 0) | (np.concatenate([[0], codes[:-1]]) != 0)
                if keep.any():
                    out.append((lang, b" ".join([w if c else b"" for w, c, k in zip([*words, b""], codes.tolist(), keep.tolist(), strict=True) if k]), codes[keep].tobytes()))
            if out:
                lang, words, codes = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(words, pa.binary()), pa.array(codes, pa.binary())], names=["lang", "words", "codes"])

    return texts.mapInArrow(run, "lang string, words binary, codes binary")


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32)


def _keys(codes: np.ndarray, size: int) -> np.ndarray:
    """Keys of size words from each place on; size - 1 places at the end have none. Only keys of
    places with so many words before the next break mean anything."""
    c = codes.astype(np.uint64)
    out = mixed(c)
    for i in range(1, size):
        out = paired(out[:-1], c[i:])
    return out


def _whole(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The places among at that have size words before the next break."""
    at = at[at <= len(codes) - size]
    for i in range(size):
        at = at[codes[at + i] != 0]
    return at


def _starts(codes: np.ndarray, table: np.ndarray, band: int, size: int, below: list[np.ndarray]) -> np.ndarray:
    """Places of a band's first words with size words, the bitmaps of fewer words allowing."""
    at = _whole(codes, np.flatnonzero(_places(table, codes) == band), size)
    for m, bits in enumerate(below, 2):
        at = at[has(bits, _keys(codes, m)[at])]
    return at


def _key_counts(rows: DataFrame, places: Callable[[np.ndarray], np.ndarray], size: int, least: int) -> DataFrame:
    """(key) of places with size words that occur least times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

        for b in batches:
            codes = _flat(b.column(0))
            at = places(codes)
            if len(at):
                held, n = [*held, _keys(codes, size)[at]], n + len(at)
            if n > 1 << 20:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    found = rows.select("codes").mapInArrow(run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def _phrases(rows: DataFrame, table: np.ndarray, band: int, below: list[np.ndarray], most: int) -> DataFrame:
    """(lang, words, prev, n): what stands at a band's places whose pair is frequent, cut after two
    words where the triple isn't; prev is the word before, null if it differs or there is none."""
    shared = rows.sparkSession.sparkContext.broadcast((table, below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, below = shared.value
        held: dict[tuple[str, bytes], list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            for low in range(0, len(keys), 10_000):
                part = keys[low : low + 10_000]
                made = [held[k] for k in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in part]), pa.array([k[1] for k in part], pa.binary()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[0] for m in made], pa.int64())], names=["lang", "words", "prev", "n"]
                )
            held.clear()

        for b in sliced(batches):
            codes = _flat(b.column(2))
            pairs = _starts(codes, table, band, 2, below[:1])
            ends = np.flatnonzero(codes == 0)
            long = np.zeros(len(codes), bool)
            if len(below) > 1:
                long[_starts(codes, table, band, 3, below)] = True
            size = np.where(long[pairs], np.minimum(ends[np.searchsorted(ends, pairs)] - pairs, most), 2) if len(pairs) else pairs
            rest = list(zip(pairs.tolist(), size.tolist(), strict=True))[::-1]
            base = 0
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split(b" ")
                while rest and rest[-1][0] < base + len(words):
                    at, m = rest.pop()
                    at -= base
                    key, prev = (lang, b" ".join(words[at : at + m])), (words[at - 1] or None) if at else None
                    if key in held:
                        found = held[key]
                        found[0] += 1
                        if found[1] != prev:
                            found[1] = None
                    else:
                        held[key] = [1, prev]
                base += len(words)
            if len(held) > HELD:
                yield from out()
        yield from out()

    return rows.select("lang", "words", "codes").mapInArrow(run, "lang string, words binary, prev binary, n long")


def _grown(found: DataFrame, least: int, most: int) -> DataFrame:
    """(lang, phrase, size, a, lasting): frequent prefixes of two words or more; lasting is false if all
    occurrences have the same next or the same previous word (and a phrase may be longer)."""
    words = F.split(F.col("words").cast("string"), " ", -1)
    prefix = F.explode(F.expr("transform(sequence(2, size(w)), m -> struct(m as size, array_join(slice(w, 1, m), ' ') as phrase, get(w, m) as next))"))
    rows = found.select("lang", words.alias("w"), F.col("prev").cast("string").alias("prev"), "n").select("lang", "prev", "n", prefix.alias("p")).select("lang", "p.*", "prev", "n")
    same = "(bool_and({0} is not null) and min({0}) = max({0}))"
    out = rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"), F.expr(same.format("next")).alias("on"), F.expr(same.format("prev")).alias("back"))
    return out.where(F.col("a") >= least).select("lang", "phrase", "size", "a", (~(F.col("on") | F.col("back")) | (F.col("size") == most)).alias("lasting"))


def _asked(rows: DataFrame, wanted: DataFrame, keep: Scratch, most: int) -> DataFrame:
    """(lang, phrase, f): counts of the wanted (lang, phrase), of two words or more."""
    spark = rows.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_keys(np.array([Codes(lang)[w] for w in p.encode().split(b" ")], np.uint32), p.count(" ") + 1) for lang, p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64))], names=["key"])

    bits = bitmap(keep(wanted.mapInArrow(keys, "key long").distinct(), "wanted-keys"), "key")
    if bits is None:
        return spark.createDataFrame([], "lang string, phrase string, f long")
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in sliced(batches):
            codes = _flat(b.column(2))
            places = []
            for m in range(2, most):
                at = _whole(codes, np.flatnonzero(codes), m)
                at = at[has(shared.value, _keys(codes, m)[at])]
                places += zip(at.tolist(), [m] * len(at), strict=True)
            places.sort(reverse=True)
            base = 0
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, counts = text.split(b" "), held.setdefault(lang, Counter())
                while places and places[-1][0] < base + len(words):
                    at, m = places.pop()
                    counts[b" ".join(words[at - base : at - base + m])] += 1
                base += len(words)
            if sum(map(len, held.values())) > HELD:
                yield from _emptied(held, ["lang", "phrase", "f"])
        yield from _emptied(held, ["lang", "phrase", "f"])

    found = rows.select("lang", "words", "codes").mapInArrow(run, "lang string, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).join(wanted, ["lang", "phrase"], "left_semi")


def _cuts(found: DataFrame) -> DataFrame:
    """A row for each cut: first and rest."""
    at = F.explode(F.expr("transform(sequence(1, size - 1), k -> struct(k, array_join(slice(split(phrase, ' ', -1), 1, k), ' ') as first, array_join(slice(split(phrase, ' ', -1), k + 1, size), ' ') as rest))"))
    return found.withColumn("cut", at).select(*found.columns, "cut.*")


def scored(found: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the lowest cut; counts has (lang, phrase, f) of all parts."""
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = _cuts(found).join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    big = lambda x: f"cast({x} as decimal(19,0))"
    score = F.expr(f"cast({big('a')} * {big('n')} as decimal(38,0)) * 1000BD div cast({big('l')} * {big('r')} as decimal(38,0))")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language with their rank; parts of a language are ranked before it is."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, step: int = STEP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases. Written to the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    texts = _texts(docs, text, lang)
    with Scratch(spark, "collocations") as keep:
        counted = keep(word_counts(texts).where(F.col("word").isNull() | (F.col("n") >= least)), "words")
        totals, words = counted.where("word is null").select("lang", "n"), counted.where("word is not null")
        table = bands(words, least, step)
        rows = keep(runs(texts, table), "runs")
        counts = words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
        open_langs = {r["lang"]: r["n"] for r in totals.collect()}
        done = spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
        last = max((int(b) for b in np.unique(table) if b != NO_BAND), default=-1)
        for band in range(last + 1):
            if not open_langs:
                break
            part = rows.where(F.col("lang").isin(*open_langs))
            below: list[np.ndarray] = []
            for size in (2, 3)[: most - 1]:
                shared = spark.sparkContext.broadcast((table, list(below)))
                places = lambda codes, s=shared, z=size: _starts(codes, s.value[0], band, z, s.value[1])  # noqa: E731, B023
                bits = bitmap(keep(_key_counts(part, places, size, least), f"keys-{band}-{size}"), "key")
                if bits is None:
                    break
                below.append(bits)
            if not below:
                continue
            found = keep(_grown(_phrases(part, table, band, below, most), least, most), f"phrases-{band}")
            counts = counts.unionByName(found.select("lang", "phrase", F.col("a").alias("f")))
            suffixes = _cuts(found).where("size > k + 1").select("lang", F.col("rest").alias("phrase")).distinct()
            if band < last:
                unknown = keep(suffixes.join(counts, ["lang", "phrase"], "left_anti"), f"wanted-{band}")
                late = keep(_asked(part, unknown, keep, most), f"suffixes-{band}")
            else:
                late = spark.createDataFrame([], "lang string, phrase string, f long")
            # suffixes counted apart stay out of counts: a later band counts them itself
            new = scored(found.where("lasting").drop("lasting"), counts.unionByName(late), totals)
            done = keep(_first(done.unionByName(new), top).drop("rank"), f"best-{band}")
            worst = {r["lang"]: r["worst"] for r in done.groupBy("lang").agg(F.min("score").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= top).collect()}
            bound = least * step ** (band + 1)
            open_langs = {k: n for k, n in open_langs.items() if worst.get(k, 0) <= 1000 * n // bound}
        return saved(_first(done, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


def oracle() -> str:
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {MOST + 1})) AS m)),
c AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM c WHERE m > 1),
inside AS (SELECT DISTINCT lang, phrase FROM (
  SELECT lang, f, unnest([array_to_string(ws[1:m - 1], ' '), array_to_string(ws[2:m], ' ')]) AS phrase FROM s WHERE m > 2) b
  JOIN c USING (lang, phrase) WHERE 100 * b.f >= 100 * c.f),
k AS (SELECT lang, m, phrase, f, ws, unnest(range(1, m)) AS k FROM s),
x AS (SELECT k.lang, k.phrase, k.f AS a, k.k, l.f AS l, r.f AS r, n, (1000::HUGEINT * k.f * n) // (l.f::HUGEINT * r.f) AS score FROM k
  JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k.k], ' ') JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k.k + 1:k.m], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM x) WHERE nth = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN inside USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= {TOP}"""
