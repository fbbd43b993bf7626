"""Divergence audit, substring dedup and collocations: oracles, brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import collocations, divergence, sketches, substring_dedup

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _text string, word int, n int, key int, p int"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return c


@pytest.mark.parametrize("module", [divergence, substring_dedup, collocations])
def test_against_oracle(spark, duck, module):
    got, want = module.query(spark, SF).toPandas(), duck.sql(module.oracle()).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    order = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(want))


def made(rows: list[tuple]) -> list[tuple]:
    return [(*r, 7, "x", "y", 1, 2, 3, 4) for r in rows]


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    passage = "all of these words stand in more than one of the texts that we have here"
    long = " ".join(f"w{i % 911}" for i in range(50_000))
    rows = [
        (5, f"a start {passage} an end", "en", "s1"),
        (5, f"other {passage}", "en", "s1"),
        (3, f"{passage}", "en", "s2"),
        (None, f"without an id {passage}", "en", None),
        (9, f"{passage} {passage}", None, "s2"),
        (9, f"{passage} {passage}", None, "s2"),
        (2, None, None, None),
        (4, "", "en", "s1"),
        (6, " \n\t ", "de", "s2"),
        (7, long, "de", "s3"),
        (8, "the " * 40, "en", "s3"),
        (1, "the " * 30, "en", "s1"),
        (10, "café ÜBER   naïve\x1cword x", "fr", "s1"),
    ]
    return rows + [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))), rng.choice(["en", None]), rng.choice(["s1", "s2"])) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(edge_rows()), SCHEMA)


# --- substring dedup


def plain_removal(rows: list[tuple], length: int) -> list[tuple]:
    texts = [(i, BLANK.findall(t or "")) for i, t, *_ in rows]
    first: dict[tuple, int] = {}
    for i, ws in texts:
        for k in range(len(ws) - length + 1):
            if i is not None:
                w = tuple(ws[k : k + length])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in texts:
        gone = set()
        for k in range(len(ws) - length + 1):
            if i is not None and first[tuple(ws[k : k + length])] < i:
                gone |= set(range(k, k + length))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("length", "first"), [(13, 4), (5, 1), (3, 4), (1, 1), (8, 2)])
def test_substring_dedup_by_brute_force(docs, length, first):
    got = substring_dedup.remove(docs, length=length, first=first)
    assert got.columns == [*docs.columns, "_removal"]
    rows = [(r["doc_id"], r["_removal"]["n_words"], r["_removal"]["n_removed"], r["_removal"]["kept_sha256"], r["_removal"]["kept"]) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, plain_removal(edge_rows(), length)))
    assert {tuple(r) for r in got.select("_row", "_text", "word", "n", "key").collect()} == {("x", "y", 1, 2, 3)}


def test_substring_dedup_levels():
    assert substring_dedup.levels(13, 4) == [4, 8, 13]
    assert substring_dedup.levels(3, 4) == [3]
    assert substring_dedup.levels(40, 5) == [5, 10, 20, 40]


def test_substring_dedup_without_repeats(spark, docs):
    empty = substring_dedup.remove(docs.limit(0))
    assert empty.count() == 0 and empty.columns == [*docs.columns, "_removal"]
    alone = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r["_removal"])[:2] for r in substring_dedup.remove(alone).collect()) == [(0, 0), (3, 0)]


# --- divergence


def plain_audit(rows: list[tuple], least: int, top: int) -> list[tuple]:
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, la, so in rows:
        found = term.findall(lower(t or ""))
        counts[la or "", so or ""].update(found)
        seen[la or ""].update(set(found))
        groups.add((la or "", so or ""))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        sources = sorted(s for la, s in groups if la == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found)]
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 3), (1000, 5)])
def test_divergence_by_brute_force(docs, least, top):
    got = divergence.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(edge_rows(), least, top))


def test_divergence_of_nothing(docs):
    assert divergence.audit(docs.limit(0)).count() == 0


def test_run_boundaries_of_pairs():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 3, 500) for _ in range(4)]
    shares = [divergence.share(c, int(c.sum()) + 500) for c in columns]
    sums = np.zeros((4, 4), np.int64)
    divergence.add_pairs([(s, divergence.share(v, int(c.sum()) + 500)) for c in columns for s, v in [divergence.runs(c)]], 500, sums)
    for g in range(4):
        for h in range(4):
            assert sums[g, h] == (0 if g == h else ((shares[g] - shares[h]) ** 2 // shares[h]).sum())
    huge = np.array([(1 << 40) - 1, 0])
    assert divergence.share(huge, 1 << 50).tolist() == [1 + 1_000_000_000 * int(c + 1) // (1 << 50) for c in huge]


# --- collocations


def plain_phrases(rows: list[tuple], least: int, most: int, top: int) -> list[tuple]:
    counts, total = defaultdict(Counter), Counter()
    for _, t, la, *_ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[la or "und"] += len(ws)
            for m in range(1, most + 1):
                counts[la or "und"].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        found, n = [], total[lang]
        longer = {w for q, x in f.items() if x >= least and len(q) > 2 for w in (q[1:], q[:-1]) if f[w] <= x}
        for p, a in f.items():
            if len(p) > 1 and a >= least and p not in longer:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, x, r, n, s) for i, (s, a, p, x, r) in enumerate(found[:top])]
    return out


@pytest.mark.parametrize(("least", "most", "top", "step"), [(3, 5, 2000, 4), (2, 5, 25, 2), (5, 5, 3, 3), (4, 2, 2000, 64), (3, 3, 10, 2)])
def test_collocations_by_brute_force(docs, least, most, top, step):
    got = collocations.mine(docs, least, most, top, step).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(edge_rows(), least, most, top))


def test_collocations_stop_early(spark, docs, monkeypatch):
    """A settled language is not looked at again."""
    asked = []
    plain = collocations._phrases
    monkeypatch.setattr(collocations, "_phrases", lambda rows, table, band, below, most: asked.append(band) or plain(rows, table, band, below, most))
    rare = [(i, "alpha beta gamma", "en", "s") for i in range(10)] + [(100 + i, "the of " * 50 + ". the and" * 20, "en", "s") for i in range(10)]
    frame = spark.createDataFrame(made(rare), SCHEMA)
    got = collocations.mine(frame, 5, 5, 1, 4).collect()
    assert [r["phrase"] for r in got] == ["alpha beta gamma"] and asked == [0]


def test_collocations_of_nothing(spark, docs):
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs, 10**9).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0


def test_sketch_lets_all_keys_through(spark):
    keys = [k * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(5000)]
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key long")
    bits = sketches.bitmap(df, "key")
    assert sketches.has(bits, np.array(keys, np.uint64)).all()
    other = np.array([(k * 0xBF58476D1CE4E5B9 + 1) % (1 << 64) for k in keys], np.uint64)
    assert sketches.has(bits, other).mean() < 0.3
    assert sketches.bitmap(df.where(F.col("key") > 2**63 - 1), "key") is None
