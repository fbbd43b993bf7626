"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by hash into blocks of some BLOCK_ROWS. A source whose target
is t words of its z makes floor(t / z) whole passes over its blocks and draws the rest, without
replacement, from one more permuted pass; the last block drawn is cut inside, so the sum is the
target to a word. The blocks to draw are the source's quota. A tree over the output shards splits
the quotas of all sources: at each node the left half's share of every source is one
multivariate-hypergeometric draw. Every shard then draws its own run of each source's permuted
blocks; the runs are disjoint and cover the quota, and what a document gives to the mix is the sum
over the shards' draws of it. Rows are shuffled inside a shard.

The number of blocks and of shards follows the data. The upper levels of the tree are split on the
driver, which holds one number for each source and node there (NODES nodes), the lower ones in
tasks. One row for each source also passes through single-task windows: sources must be fewer than
some millions.

Edge cases: null text has size 0, null source is a source of its own (last in order), repeated
rows are drawn alike (of a tie at the cut the first rows give one word more, until the target is met), null and repeated doc_ids are dealt
like any other, an empty table gives an empty result, and other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch
from brindle.functions.shipping import ship
from brindle.llm.common import n_words, saved, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 256
#: Words that a shard of the mix should have, and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 3_000_000, 8
#: Nodes of the tree that the driver splits down to.
NODES = 64
#: Parts in which a source's blocks are put in order.
PARTS = 64
SEED = 20_011


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _luck(doc_id: Column, size: Column, key: Column) -> Column:
    return F.xxhash64(doc_id, size, key, F.lit(SEED))


def _block(luck: Column, n_blocks: Column) -> Column:
    return F.pmod(luck, n_blocks)


def _order(doc_id: Column, size: Column) -> Column:
    return F.xxhash64(doc_id, size, F.lit(SEED + 1))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, key, source_size) -> + target: weighted shares of ``share`` times all words, each
    at most ``most`` times its source; what is cut off is reshared by weight.

    One row per source, so the global windows hold few rows. With sources ordered by cap per
    weight, the level of the uncapped ones is the largest of (total - caps before) / (weights
    from here on).
    """
    everything, order = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("ratio", "key")
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    cap = F.col("source_size") * F.lit(float(most))
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("cap", cap).withColumn("ratio", cap / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(everything) * share - before) / left)
    level = F.max("level").over(everything)
    return out.withColumn("target", F.least("cap", F.col("weight") * level)).select("source", "key", "source_size", "target")


def descend(have: np.ndarray, low: int, high: int, draws: int, shards: int, until: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, quotas) of the nodes of at most ``until`` shards below a node of shards
    low .. high - 1, which has the quotas have of all ``draws``."""
    if high - low <= until:
        yield low, high, have
        return
    mid, total = (low + high) // 2, int(have.sum())
    # cuts at the same marks whatever the depth, so shard sizes differ by one at most
    want = draws * mid // shards - draws * low // shards
    rng = np.random.default_rng([seed, low, high])
    left = rng.multivariate_hypergeometric(have, min(want, total), method="marginals") if total else have * 0
    yield from descend(left, low, mid, draws, shards, until, seed)
    yield from descend(have - left, mid, high, draws, shards, until, seed)


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Deals quotas[s] block draws of each source s to the shards: an array (sources, shards)."""
    quotas = quotas.astype(np.int64)
    return np.stack([q for _, _, q in descend(quotas, 0, shards, int(quotas.sum()), shards, 1, seed)], axis=1)


def runs(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """quotas(key, n) -> (key, shard, first, n): the run of each source's draws that a shard makes."""
    spark = quotas.sparkSession
    # one row per source comes to the driver
    rows = sorted((r["key"], r["n"]) for r in quotas.collect())
    keys, have = [k for k, _ in rows], np.array([n for _, n in rows], dtype=np.int64)
    draws = int(have.sum())
    nodes = [(low, high, q.tolist()) for low, high, q in descend(have, 0, shards, draws, shards, -(-shards // NODES), seed)] if keys else []

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low, high, q in zip(b["low"], b["high"], b["quotas"], strict=True):
                for shard, _, mine in descend(np.array(q, dtype=np.int64), int(low), int(high), draws, shards, 1, seed):
                    at = np.flatnonzero(mine)
                    yield pd.DataFrame({"k": at, "shard": np.full(len(at), shard), "n": mine[at]})

    ship(spark)
    dealt = spark.createDataFrame(nodes, "low long, high long, quotas array<long>").repartition(max(1, len(nodes)), "low").mapInPandas(lower, "k long, shard long, n long")
    named = dealt.join(spark.createDataFrame(list(enumerate(keys)), "k long, key string"), "k")
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return named.select("key", "shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def _permuted(draws: DataFrame, seed: int) -> DataFrame:
    """draws(key, pass, block, words) + nth and before: place in the pass's order and words of the
    blocks before it. Each source is put in order in PARTS parts, so none is one task's work."""
    luck = F.xxhash64("key", "block", "pass", F.lit(seed))
    draws = draws.withColumn("luck", luck).withColumn("part", F.pmod("luck", F.lit(PARTS)))
    parts = Window.partitionBy("key", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = draws.groupBy("key", "pass", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    sums = sums.select("key", "pass", "part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(parts), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("key", "pass", "part").orderBy("luck", "block")
    out = draws.join(sums, ["key", "pass", "part"])
    nth = F.col("n0") + F.row_number().over(inside) - 1
    return out.withColumn("nth", nth).withColumn("before", F.col("w0") + F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("luck", "part", "n0", "w0")


def plan(docs: DataFrame, keep: Scratch, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, int]:
    """(sources, draws, number of shards). sources: key, source_size, target, blocks; draws: key,
    block and an array of (pass, draw, shard, cut, cut_words, more). cut is the order value at which a
    block that is not taken whole ends, cut_words the words taken of each document there, more how
    many of them give one word beyond."""
    key, size = _key(F.col("source")), n_words(F.col("text"))
    sized = docs.select("source", key.alias("key"), size.alias("size"), F.col("doc_id"))
    sized = keep(sized.select("source", "key", "size", _luck(F.col("doc_id"), F.col("size"), F.col("key")).alias("luck"), _order(F.col("doc_id"), F.col("size")).alias("at")), "sizes")
    sums = keep(sized.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "sources")
    sized = sized.join(sums.select("key", "blocks"), "key").withColumn("block", _block(F.col("luck"), F.col("blocks")))
    blocks = keep(sized.groupBy("key", "block").agg(F.sum("size").alias("words")), "blocks")
    found = blocks.groupBy("key").agg(F.count("*").alias("n_blocks"))
    goal = targets(sums.select("source", "key", "source_size")).join(sums.select("key", "blocks"), "key").join(found, "key")
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = saved(goal.withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size")), "mix-sources")
    total = goal.agg(F.sum("target")).first()[0] or 0
    shards = shards or max(LEAST_SHARDS, int(-(-total // SHARD_WORDS)))

    draws = blocks.join(goal.select("key", "n_blocks", "passes", "rest"), "key").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    draws = _permuted(draws, seed).where("pass < passes or before < rest")
    draws = draws.withColumn("limit", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("before"))))
    draws = keep(draws.select("key", "block", "words", "pass", (F.col("pass") * F.col("n_blocks") + F.col("nth")).alias("draw"), "limit"), "draws")

    # each shard draws its run of every source's permuted blocks
    mine = runs(draws.groupBy("key").agg(F.count("*").alias("n")), shards, seed)
    mine = mine.select("key", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    draws = draws.join(mine, ["key", "draw"])

    # inside the few blocks that are not taken whole, find where the words run out
    part = draws.where("limit < words").select("key", "block", "pass", "limit")
    inside = sized.join(part, ["key", "block"]).groupBy("key", "block", "pass", "limit", "at").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    running = Window.partitionBy("key", "block", "pass").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    cut = inside.where("before < limit and before + size >= limit").select("key", "block", "pass", F.col("at").alias("cut"), F.floor((F.col("limit") - F.col("before")) / F.col("n")).alias("cut_words"), F.expr("(limit - before) % n").alias("more"))
    draws = draws.join(cut, ["key", "block", "pass"], "left")
    draws = draws.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "draw", "shard", "cut", "cut_words", "more"))).alias("draws"))
    return goal, saved(draws, "mix-draws"), shards


def _drawn(docs: DataFrame, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    with Scratch(docs.sparkSession, "mix") as keep:
        goal, draws, n = plan(docs, keep, shards, seed)
    goal = goal.select(*[F.col(c).alias(f"_mix_{c}") for c in ("key", "source_size", "target", "blocks")])
    draws = draws.select(*[F.col(c).alias(f"_mix_{c}") for c in ("key", "block", "draws")])
    out = docs.withColumn("_mix_key", _key(F.col("source"))).withColumn("_mix_size", n_words(F.col("text")))
    # a few numbers for each source and block; the planner broadcasts them while they are small,
    # else rows are dealt by (source, block), which no hot source can skew
    out = out.join(goal, "_mix_key", "left").withColumn("_mix_at", _order(F.col("doc_id"), F.col("_mix_size")))
    out = out.withColumn("_mix_block", _block(_luck(F.col("doc_id"), F.col("_mix_size"), F.col("_mix_key")), F.col("_mix_blocks")))
    out = out.join(draws, ["_mix_key", "_mix_block"], "left")
    # equal rows at a cut are told apart by number; all others need none
    tied = F.exists(F.coalesce("_mix_draws", F.array()), lambda d: F.coalesce((d["cut"] == F.col("_mix_at")) & (d["more"] > 0), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("_mix_key", "_mix_block", "_mix_at").orderBy(F.lit(0)))
    if draws.where(F.exists("_mix_draws", lambda d: d["more"] > 0)).isEmpty():
        out = out.withColumn("_mix_nth", F.lit(0))
    else:
        out = out.where(~tied).withColumn("_mix_nth", F.lit(0)).unionByName(out.where(tied).withColumn("_mix_nth", nth))
    taken = "transform(coalesce(_mix_draws, array()), d -> struct(d.pass as pass, d.shard as shard, case when d.cut is null or _mix_at < d.cut then _mix_size when _mix_at = d.cut then d.cut_words + if(_mix_nth between 1 and d.more, 1, 0) else 0L end as words))"
    out = out.withColumn("_mix_draws", F.filter(F.expr(taken), lambda d: d["words"] > 0)).drop("_mix_key", "_mix_block", "_mix_at", "_mix_blocks", "_mix_nth")
    return out, n


def with_draws(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """docs + _mix_size, _mix_source_size, _mix_target and _mix_draws, an array of (pass, shard,
    words) with one entry for each draw by which a shard takes the document, wholly or cut."""
    return _drawn(docs, shards, seed)[0]


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the columns of docs, once for each time taken (a cut document keeps its
    first words), with _mix_pass and _mix_shard, shuffled inside each shard."""
    return mixed_rows(docs, shards, seed).select("_row.*", "_mix_pass", "_mix_shard")


def mixed_rows(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of docs as one struct, _row, where no name of theirs can
    clash, beside _mix_pass and _mix_shard."""
    rows, shards = _drawn(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text"), shards, seed)
    rows = rows.withColumn("_mix_draw", F.explode("_mix_draws"))
    pieces = F.regexp_extract_all("_row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(pieces, 1, F.col("_mix_draw.words").cast("int")), "")
    text = F.when(F.col("_mix_draw.words") < F.col("_mix_size"), first).otherwise(F.col("_row.text"))
    rows = rows.select(F.col("_row").withField("text", text).alias("_row"), F.col("_mix_draw.pass").alias("_mix_pass"), F.col("_mix_draw.shard").alias("_mix_shard"))
    return rows.repartition(shards, "_mix_shard").sortWithinPartitions("_mix_shard", F.xxhash64("_row.doc_id", "_mix_pass", F.lit(seed + 2)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    taken = F.aggregate("_mix_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return with_draws(docs).select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"), F.transform("_mix_draws", lambda d: d["shard"]).alias("shards")
    )
