"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text: its words, lower-cased and hashed into WORD_BUCKETS, weighing log(1 + count)
and scaled to unit length together; and structure statistics and metadata that follow from the
text alone (lengths, ratios of capitals, symbols, repeats, lines), each cut at training quantiles
into one of BINS indicator features. The machine's pairwise part is a sum over factors of
((sum v x)^2 - sum v^2 x^2) / 2, linear in the number of features.

Training takes at most TRAIN_DOCS labelled rows, the first by hash among those not held out that
``docs`` holds, rows of one id and text counting once; their sparse features go to the driver,
where the machine is fitted by Adam steps.

Edge cases: null text counts as empty; an empty text has a score from its statistics alone; very
long texts are used whole; without labels every score is 0.5; documents with several labels take
the lowest; repeated rows are scored alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import WORD_RE, each_text, held_out, table

WORD_BUCKETS = 1 << 15
BINS = 12
FACTORS = 8
TRAIN_DOCS = 8_000
EPOCHS = 8
CUT = 0.7
_CAPS, _SYMBOLS, _DIGITS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[#*$%&|<>{}\[\]\\^~=+@_]"), re.compile(r"\d")
N_STATS = 13


class Model(NamedTuple):
    edges: np.ndarray  # (N_STATS, BINS - 1)
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(word buckets, their values, structure statistics) of a whole text."""
    words = WORD_RE.findall(text)
    counts = Counter(words)
    n, chars, distinct = len(words), len(text), len(counts)
    buckets: Counter = Counter()
    for w, k in counts.items():
        buckets[zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS] += k
    index = np.fromiter(buckets, dtype=np.int64, count=len(buckets))
    value = np.log1p(np.fromiter(buckets.values(), dtype=float, count=len(buckets)))
    value /= max(1e-9, float(np.sqrt((value**2).sum())))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda k, of: k / of if of else 0.0
    stats = [
        float(np.log1p(n)),
        share(sum(map(len, counts.elements())), n) if n < 2000 else share(sum(len(w) * k for w, k in counts.items()), n),
        share(len(_CAPS.findall(text)), chars),
        share(len(_SYMBOLS.findall(text)), chars),
        share(len(_DIGITS.findall(text)), chars),
        share(text.count("!") + text.count("?"), n),
        share(text.count("|"), n),
        share(text.count(".") + text.count(","), n),
        share(distinct, n),
        share(max(counts.values(), default=0), n),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        share(len(set(lines)), len(lines)),
        float(np.log1p(share(chars, len(lines)))),
    ]
    return index, value, stats


def _binned(edges: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Feature numbers of the statistics' bins, one per statistic."""
    bins = np.stack([np.searchsorted(edges[i], stats[:, i], side="right") for i in range(N_STATS)], axis=1)
    return WORD_BUCKETS + np.arange(N_STATS) * BINS + bins


def pairwise(v: np.ndarray, x: np.ndarray) -> float:
    """The sum over i < j of <v_i, v_j> x_i x_j, in time linear in the number of features."""
    vx = v * x[:, None]
    return 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())


def train(rows: list[tuple[int, list[int], list[float], list[float]]], seed: int = 5) -> Model:
    """rows: (label, word buckets, values, statistics)."""
    size = WORD_BUCKETS + N_STATS * BINS
    rng = np.random.default_rng(seed)
    if not rows:
        return Model(np.zeros((N_STATS, BINS - 1)), 0.0, np.zeros(size), np.zeros((size, FACTORS)))
    label = np.array([r[0] for r in rows], dtype=float)
    stats = np.array([r[3] for r in rows])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    bins = _binned(edges, stats)
    words = [np.array(r[1], dtype=np.int64) for r in rows]
    values = [np.array(r[2]) for r in rows]
    rate = np.clip(label.mean(), 0.01, 0.99)
    bias, w, v = float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    mw, sw, mv, sv, step = np.zeros(size), np.zeros(size), np.zeros_like(v), np.zeros_like(v), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 256):
            part = order[low : low + 256]
            x_at = np.concatenate([np.concatenate([words[i], bins[i]]) for i in part])
            x = np.concatenate([np.concatenate([values[i], np.ones(N_STATS)]) for i in part])
            count = np.array([len(words[i]) + N_STATS for i in part])
            starts, row = np.cumsum(count) - count, np.repeat(np.arange(len(part)), count)
            vx = v[x_at] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = bias + np.add.reduceat(w[x_at] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)
            touched, at = np.unique(x_at, return_inverse=True)
            gw = np.bincount(at, error[row] * x, len(touched)) + 1e-6 * w[touched]
            push = error[row, None] * x[:, None] * (total[row] - vx)
            gv = np.stack([np.bincount(at, push[:, f], len(touched)) for f in range(FACTORS)], axis=1) + 1e-5 * v[touched]
            step += 1
            bias -= 0.05 * float(error.sum())
            for p, g, m, s, lr in ((w, gw, mw, sw, 0.02), (v, gv, mv, sv, 0.01)):
                m[touched] = 0.9 * m[touched] + 0.1 * g
                s[touched] = 0.99 * s[touched] + 0.01 * g * g
                p[touched] -= lr * (m[touched] / (1 - 0.9**step)) / (np.sqrt(s[touched] / (1 - 0.99**step)) + 1e-8)
    return Model(edges, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    luck = F.xxhash64("doc_id", "_h", F.lit(3))
    # the documented bound: different labelled texts that docs holds, the first by hash
    chosen = rows.select("doc_id", "_h").join(known, "doc_id").distinct().orderBy(luck, "doc_id", "_h").limit(most)
    label = {(r["doc_id"], r["_h"]): r["quality"] for r in chosen.collect()}
    if not label:
        return train([])
    # repeated rows are made one before their features are taken and sent
    texts = rows.join(chosen.select("doc_id", "_h"), ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h"])

    def sparse(texts: list[str]) -> dict:
        got = [features(t) for t in texts]
        return {"at": pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), "x": pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32())), "stats": pa.array([g[2] for g in got], pa.list_(pa.float64()))}

    numbered = texts.withColumn("_n", luck)
    by_luck = {r["_n"]: label[r["doc_id"], r["_h"]] for r in chosen.withColumn("_n", luck).collect()}
    found = each_text(numbered, sparse, "at array<int>, x array<float>, stats array<double>", "_n")
    return train([(by_luck[r["_n"]], r["at"], r["x"], r["stats"]) for r in sorted(found.toLocalIterator(), key=lambda r: r["_n"])])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability that a text would be labelled 1."""
    edges, bias, weights, factors = model
    weights, factors = weights.astype(np.float32), factors.astype(np.float32)

    def score(texts: list[str]) -> dict:
        out = []
        for t in texts:
            at, x, stats = features(t)
            at = np.concatenate([at, _binned(edges, np.array([stats]))[0]])
            x = np.concatenate([x, np.ones(N_STATS)])
            z = bias + float(weights[at] @ x) + pairwise(factors[at], x)
            out.append(float(1 / (1 + np.exp(-min(max(z, -30), 30)))))
        return {"score": pa.array(out, pa.float64())}

    return each_text(docs, score, "score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
