"""SimHash near-dedup over vantage-point trees.

Fingerprints link at Hamming distance RADIUS = 3 or less. Two fingerprints that close differ in at
most one bit of their upper or of their lower half, so there is one vantage-point tree for each
half: an inner node has a vantage point and a distance t, and sends what lies within t to its left
child, the rest to its right. A fingerprint is a member of one leaf (a shard) of each tree; as a
query it also reaches every shard that its ball of radius 1 touches, which the triangle inequality
tells: left if d - 1 <= t, right if d + 1 > t. Of two linked fingerprints with different shards
each reaches the other's, so a query visits only shards before its own. Within a shard members and
visitors are compared with all members on all 64 bits, through a vantage-point tree of the task's
own. So every linked pair meets, in one tree or the other.

The trees are fitted on a sample of one fingerprint in PER_SAMPLE (at most SAMPLE); all fingerprints
are indexed. A shard of more than TILE rows is compared in tiles, each a task of its own. A tile
does not give its pairs but a forest of links that joins the same fingerprints, so a large group of
near copies costs rows by its size, not by its square. Copies (equal fingerprints) are one node
throughout.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; a text of
fewer words than a shingle is one shingle; very long texts are hashed in runs; repeated rows are
copies; null doc_ids take part, and get the least non-null id of their component (null if there is
none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch
from brindle.functions.shipping import ship
from brindle.llm.common import each_text, saved, table
from brindle.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that a shard should hold, and that a leaf of a task's own tree should.
SHARD = 16_384
LEAF = 512
#: The trees are fitted on one fingerprint in so many, SAMPLE at most.
PER_SAMPLE = 256
SAMPLE = 1 << 20
TILE = 65_536
_HALVES = ((32, 0xFFFFFFFF), (0, 0xFFFFFFFF))


def lowered(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case; bytes are split at just the blanks that end words."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes set each bit."""
    out = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[low : low + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64)
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes set."""
    return int.from_bytes(np.packbits(2 * ones(hashes) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; bit i is set where over half of the hashes set it."""
    from xxhash import xxh64_intdigest

    words = lowered(text)
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], blanks + 1]).tolist()
    ends = np.concatenate([blanks, [len(joined)]]).tolist()[k - 1 :]
    return majority(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number)."""

    def each(texts: list[str]) -> dict:
        return {"fp": pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))}

    return each_text(docs, each, "fp long")


def _half(fp: np.ndarray, tree: int) -> np.ndarray:
    shift, mask = _HALVES[tree]
    return ((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64(mask)).astype(np.uint32)


def grow(sample: np.ndarray, leaf: int, seed: int = 1) -> list:
    """A tree over half fingerprints: nodes (vantage, t, left, right), leaves (None, number)."""
    rng, nodes, leaves = np.random.default_rng(seed), [], [0]

    def node(points: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        best = None
        if len(points) > leaf:
            for vantage in rng.choice(points, min(6, len(points)), replace=False):
                d = np.bitwise_count(points ^ vantage)
                t = int(np.median(d))
                for cut in (t - 1, t):
                    inside = int((d <= cut).sum())
                    # queries that must look on both sides, and how uneven the sides are
                    cost = ((d == cut) | (d == cut + 1)).mean() + 2 * abs(inside / len(d) - 0.5)
                    if 0 < inside < len(d) and (best is None or cost < best[0]):
                        best = (cost, int(vantage), cut, d <= cut)
        if best is None:
            nodes[at] = (None, leaves[0])
            leaves[0] += 1
        else:
            _, vantage, cut, inside = best
            nodes[at] = (vantage, cut, node(points[inside]), node(points[~inside]))
        return at

    node(sample)
    return nodes


def route(nodes: list, half: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that a ball of radius reach touches; reach 0 gives the member's leaf."""
    rows, leaves, todo = [], [], [(0, np.arange(len(half)))]
    while todo:
        at, who = todo.pop()
        if not len(who):
            continue
        if nodes[at][0] is None:
            rows.append(who)
            leaves.append(np.full(len(who), nodes[at][1]))
            continue
        vantage, t, left, right = nodes[at]
        d = np.bitwise_count(half[who] ^ np.uint32(vantage)).astype(np.int64)
        todo += [(left, who[d - reach <= t]), (right, who[d + reach > t])]
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(leaves) if leaves else np.zeros(0, int)


def forest(all_: np.ndarray, members: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join all pairs of all_ x members within radius, few for each row."""
    every = np.unique(np.concatenate([all_, members]))
    a_at, m_at = np.searchsorted(every, all_), np.searchsorted(every, members)
    label, u, v = np.arange(len(every)), [], []
    for low in range(0, len(all_), 256):
        near = np.bitwise_count(all_[low : low + 256, None] ^ members[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            who = np.flatnonzero(near[i])
            seen, first = np.unique(label[m_at[who]], return_index=True)
            mine = label[a_at[low + i]]
            for x, k in zip(seen.tolist(), first.tolist(), strict=True):
                if x != mine:
                    u.append(all_[low + i])
                    v.append(members[who[k]])
            if len(seen) > 1 or seen[0] != mine:
                label[np.isin(label, np.append(seen, mine))] = min(int(seen[0]), int(mine))
    return np.array(u, dtype=np.uint64), np.array(v, dtype=np.uint64)


def linked(all_: np.ndarray, members: np.ndarray, tree: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """forest() of fingerprints that are near in one half, through a tree of the members."""
    reach = radius // len(_HALVES)
    half = _half(members, tree)
    nodes = grow(half, LEAF)
    row, leaf = route(nodes, half, 0)
    seen, at = route(nodes, _half(all_, tree), reach)
    by_leaf, by_visit = np.argsort(leaf, kind="stable"), np.argsort(at, kind="stable")
    row, leaf, seen, at = row[by_leaf], leaf[by_leaf], seen[by_visit], at[by_visit]
    u, v = [], []
    for k in np.unique(leaf).tolist():
        mine = members[row[np.searchsorted(leaf, k) : np.searchsorted(leaf, k, side="right")]]
        a, b = forest(all_[seen[np.searchsorted(at, k) : np.searchsorted(at, k, side="right")]], mine, radius)
        u.append(a)
        v.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate(u or [none]), np.concatenate(v or [none])


def links(groups: DataFrame, n: int, keep: Callable[[DataFrame, str], DataFrame] = saved, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints of groups (column fp, n rows) that join all
    those within radius. keep writes the tables between."""
    spark = groups.sparkSession
    reach = radius // len(_HALVES)
    size = min(SAMPLE, -(-n // PER_SAMPLE))
    one_in = max(1, n // max(1, size))
    drawn = groups.where(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(one_in)) == 0).orderBy("fp").limit(SAMPLE)
    sample = drawn.select("fp").toArrow().column(0).to_numpy()
    per_leaf = max(1, SHARD // one_in)
    trees = [grow(_half(sample, t), per_leaf, t) for t in range(len(_HALVES))]
    held = spark.sparkContext.broadcast(trees)  # nodes of a tree over at most SAMPLE points
    ship(spark)

    def to_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            for t, nodes in enumerate(held.value):
                half = _half(fp, t)
                home = _in_order(*route(nodes, half, 0))
                row, leaf = route(nodes, half, reach)
                row, leaf = row[leaf <= home[row]], leaf[leaf <= home[row]]
                yield pd.DataFrame({"tree": np.full(len(row), t, np.int32), "leaf": leaf.astype(np.int32), "fp": fp[row], "member": home[row] == leaf})

    shards = keep(groups.select("fp").mapInPandas(to_shards, "tree int, leaf int, fp long, member boolean"), "shards")
    # one row per shard: how many tiles its members, and its members and visitors, make
    sizes = keep(shards.groupBy("tree", "leaf").agg(F.ceil(F.count_if("member") / TILE).cast("int").alias("m"), F.ceil(F.count("*") / TILE).cast("int").alias("a")), "sizes")
    tiles = shards.join(sizes, ["tree", "leaf"])
    luck = F.xxhash64("fp", F.lit(13))
    asked = tiles.withColumn("i", F.pmod(luck, F.col("a")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("side", F.lit(0))
    kept = tiles.where("member").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a") - 1))).withColumn("j", F.pmod(luck, F.col("m")).cast("int")).withColumn("side", F.lit(1))
    cols = ["tree", "leaf", "i", "j", "side", "fp"]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        u, v = linked(fp[side == 0], fp[side == 1], int(rows["tree"].iloc[0]), radius)
        return pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64)})

    return asked.where("m > 0").select(cols).union(kept.select(cols)).groupBy("tree", "leaf", "i", "j").applyInPandas(compare, "a long, b long")


def _in_order(row: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), dtype=np.int64)
    out[row] = leaf
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links of near fingerprints reach."""
    with Scratch(docs.sparkSession, "simhash") as keep:
        fps = saved(fingerprints(docs, shingle), "simhash-fps")
        groups = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
        found = keep(links(groups, groups.count(), keep, radius), "links")
        joined = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), keep)
        # few fingerprints have links: only those are given a component's least id
        named = joined.withColumnRenamed("node", "fp").join(groups, "fp")
        ids = named.groupBy("label").agg(F.min("least").alias("component"))
        named = keep(named.join(ids, "label").select("fp", "component"), "components")
        groups = saved(groups.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "simhash-groups")
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies (five-word shingles, Jaccard 0.8 or more)."""
    from brindle.llm.near_copies import keep_first

    return keep_first(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
