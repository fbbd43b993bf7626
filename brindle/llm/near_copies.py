"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more.

SimHash and its vantage-point trees give the first candidates, by fingerprints over the same
shingles within three bits. Texts that similar often lie further apart (at 0.8 about ten bits of
64), where no fingerprint search finds them all, so an exact join finds the rest, by prefixes. All
shingles stand in one global order (rare before common, then by hash); of a set of n, the first
n - ceil(SIMILAR n) + 1 are its prefix, and two sets that similar share a shingle of their prefixes,
the first one so early in both that enough shingles follow. The order comes from a sample of texts,
but any order finds every pair: the sample only keeps common passages out of the prefixes. It follows
the input, so that a passage it misses stands in so many texts, not in such a share of them, whose
pairs would grow with the square of the input.
The index of shared shingles is written in buckets by shingle, so it is shuffled once for what follows;
what of it the sample calls hot stands in a plain table, where joins may split a shingle's rows. Near
copies share many shingles, so of those that the same texts have only the first goes on.

Candidates are checked twice: a bitmap of some two bits for each shingle holds the parity of the
shingles that fall on each bit, so two bitmaps differ in no more bits than the sets do in shingles,
which rules out most pairs and never a similar one (the longer bitmap of a pair is folded to the
shorter one's size); the rest are checked on the texts' whole sets. Texts are dealt for that, and rows
for the last join with what goes, only where a bitmap of the keys looked for lets them through, so
the others are never shuffled. So that a large group
of near copies costs rows by its size, each text is first compared with CENTRES centres for each
shared shingle and with its neighbours by fingerprint; what that links is one component. Centres
are drawn again among components that share shingles while that finds links, and only texts that are
then still in different ones are compared pair by pair. A shingle that
many dissimilar texts share and that the sample missed costs its square there.

Edge cases: null and empty texts are copies of each other; a text of fewer words than a shingle is
one shingle; very long texts are used whole; rows with equal sets are one node, whatever their ids,
null or repeated ones included; rows that share a doc_id but not a text are different rows; an
empty table gives an empty one; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.scratch import Scratch
from brindle.functions.shipping import ship
from brindle.llm.common import saved, sliced
from brindle.llm.components import components
from brindle.llm.simhash import links, lowered, majority
from brindle.llm.sketches import thinned

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 80
#: Texts that the order is learned from at least, else one in ONE_IN, how many of them make a shingle
#: common, and how many common shingles are held at most.
SAMPLE, ONE_IN, COMMON, HELD = 4096, 16, 4, 65_536
#: One sampled text in so many makes a shingle hot.
HOT = 64
#: Prefix shingles that a bucket of the index should take in at most.
BUCKET = 4_000_000
#: Nodes whose prefixes a task remembers to have given, so that not each of many copies gives them.
SEEN = 65_536
BITS = 1024
#: Centres drawn for each shared shingle, which every text that has it is first compared with, and
#: how often at most, each time among texts that are not yet joined; a turn follows where the one
#: before found a link in YIELD pairs.
CENTRES, TURNS, YIELD = 4, 6, 50


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = lowered(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(xxh64_intdigest, words)), dtype=np.uint64)
    k = min(SHINGLE, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):  # wraps at 64 bits
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[i : len(words) - k + 1 + i]
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB))


def prefix_size(n: int) -> int:
    return n - -(-SIMILAR * n // 100) + 1 if n else 0


def parities(s: np.ndarray, bits: int = BITS) -> bytes:
    """For each of some bits, a power of two, whether an odd number of the shingles fall on it."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def bitmap(s: np.ndarray) -> bytes:
    """parities of two to four bits for each shingle, 256 at least."""
    return parities(s, 1 << max(8, (2 * len(s) - 1).bit_length()))


def folded(x: bytes, size: int) -> np.ndarray:
    """The bitmap that the same shingles make with ``size`` bytes, a smaller power of two."""
    out = np.frombuffer(x, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def bitmaps_near(n: int, m: int, x: bytes, y: bytes) -> bool:
    size = min(len(x), len(y))
    return bool(may_be_similar(np.array([n]), np.array([m]), folded(x, size)[None, :], folded(y, size)[None, :])[0])


def may_be_similar(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False where bitmaps (rows of a and b) of sets of n and m shingles differ too much: similar
    sets differ in (100 - SIMILAR) / (100 + SIMILAR) of n + m shingles at most."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (100 + SIMILAR) * differ <= (100 - SIMILAR) * (n + m)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Common shingles of a sample of texts, sorted, their counts, and the count of a hot one."""
    all_ = rows.count()
    n = max(1, min(ONE_IN, all_ // SAMPLE))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    drawn = rows.select("text").where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(n)) == 0).distinct()
    counts = drawn.mapInArrow(each, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    found = counts.orderBy(F.desc("c"), "s").limit(HELD).toArrow()
    s, c = (found.column(k).to_numpy() for k in ("s", "c"))
    order = np.argsort(s.view(np.uint64))
    return s.view(np.uint64)[order], c[order], max(SAMPLE, all_ // n) // HOT


_KEY = ["id", "text_hash", "rest_hash"]
_ROWS = "node long, n long, fp long, bits binary, cold int, prefix array<long>"


def _key(docs: DataFrame, prefix: str = "") -> list:
    """id, text_hash and rest_hash (of all other columns), which name a row."""
    others = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0).cast("long")
    return [c.alias(prefix + n) for c, n in zip((F.col("doc_id").cast("long"), F.xxhash64("text"), rest), _KEY, strict=True)]


def prefixes(rows: DataFrame) -> DataFrame:
    """The key of each row, node (a hash of the set of shingles), n (its size), fp (its SimHash),
    bits (its parities), prefix and cold, how many of the prefix come before its hot shingles. Of
    equal sets a task gives the prefix of the first, and none (null) of most others."""
    spark = rows.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(_common(rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        common, counts, hot = held.value
        seen = set()
        for b in sliced(batches):
            nodes, sizes, prints, bits, colds, firsts = [], [], [], [], [], []
            for t in b.column(3).to_pylist():
                s = shingles(t)
                nodes.append(xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                prints.append(majority(s))
                bits.append(bitmap(s))
                if nodes[-1] in seen:
                    colds.append(0)
                    firsts.append(None)
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(nodes[-1])
                often = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = np.where(common[at] == s, counts[at], 0)
                order = np.argsort(often, kind="stable")[: prefix_size(len(s))]
                colds.append(int(np.searchsorted(often[order], hot)))
                firsts.append(s[order].view(np.int64))
            made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(colds, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=[*_KEY, "node", "n", "fp", "bits", "cold", "prefix"])

    return rows.mapInArrow(each, ", ".join(f"{c} long" for c in _KEY) + ", " + _ROWS)


def _checked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, keep: Scratch) -> DataFrame:
    """Those of pairs (u, v) of nodes whose sets of shingles are similar."""

    def bits_near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = list(map(bitmaps_near, b["n"], b["m"], b["x"], b["y"]))
            yield b.loc[np.array(near, dtype=bool), ["u", "v"]]

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "shingles": [shingles(t).tobytes() for t in b["text"].tolist()]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[np.array(ok, dtype=bool), ["u", "v"]]

    x = nodes.select(F.col("node").alias("u"), "row.n", F.col("row.bits").alias("x"))
    y = nodes.select(F.col("node").alias("v"), F.col("row.n").alias("m"), F.col("row.bits").alias("y"))
    pairs = keep(pairs.join(x, "u").join(y, "v").select("u", "v", "n", "m", "x", "y").mapInPandas(bits_near, "u long, v long"), "checked")
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    # each node has one row that stands for it, found by its id and text; equal rows by the text's hash
    wanted = keep(nodes.join(asked, "node", "left_semi").select("node", F.col("row.id").alias("d"), F.col("row.text_hash").alias("h")), "wanted")
    asked, _ = thinned(texts, ["id", "text_hash"], wanted, ["d", "h"])
    found = asked.join(wanted, F.col("id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("text_hash")))
    whole = keep(found.select("node", "text").dropDuplicates(["node"]).mapInPandas(sets, "node long, shingles binary"), "sets")
    x = whole.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    y = whole.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    return keep(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInPandas(each, "u long, v long"), "links")


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _by_fingerprint(nodes: DataFrame, keep: Scratch) -> DataFrame:
    """(u, v): nodes whose fingerprints op8's trees link, through one node for each fingerprint."""
    prints = keep(nodes.groupBy("row.fp").agg(F.min("node").alias("first")), "prints")
    found = links(prints, prints.count(), keep)
    ends = found.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
    alike = nodes.select("node", "row.fp").join(prints, "fp").where("node <> first")
    return ends.select(*_pairs("u", "v")).union(alike.select(*_pairs("node", "first")))


def _indexes(rows: DataFrame, keep: Scratch) -> list[DataFrame]:
    """(s, node, n, at): the prefix shingles that several nodes have, and their places; first the
    cold ones, then the hot ones. Of shingles that the same nodes have, the first in the order stands
    for all."""
    spark = rows.sparkSession
    index = rows.where("prefix is not null").select("node", "n", "cold", F.posexplode("prefix").alias("at", "s")).withColumn("s32", F.expr("cast(shiftright(s, 32) as int)"))
    # which shingles stand in several prefixes, told by halves of the hashes to move less; two that
    # share a half only send a few rows more on
    short = index.select("s32", F.hash("node").alias("node32"))
    shared = keep(short.groupBy("s32").agg(F.min("node32").alias("low"), F.max("node32").alias("high")).where("low <> high").select("s32"), "shared")
    total = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    index = index.join(shared, "s32", "left_semi").select("s", "node", "n", "at", (F.col("at") >= F.col("cold")).alias("hot"))
    cold = index.where("not hot").drop("hot").repartition(n, "s").dropDuplicates(["s", "node"])
    hot = index.where("hot").drop("hot").dropDuplicates(["s", "node"])
    return [keep(_firsts(keep.bucketed(cold, "cold", "s", n)), "cold-firsts"), keep(_firsts(keep(hot, "hot")), "hot-firsts")]


def _firsts(index: DataFrame) -> DataFrame:
    """index without shingles that one node has, or just the nodes that have an earlier one. No pair is
    lost: the first shingle that two sets share is the first of those that the same nodes have."""
    members = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("hashes"), F.min(F.struct("node", "at")).alias("low")]
    several = index.groupBy("s").agg(*members).where("c > 1")
    # one order holds for all texts, so any one node's places tell which comes first
    first = several.groupBy("c", "hashes", "low.node").agg(F.min(F.struct("low.at", "s")).alias("first")).select("first.s")
    return index.join(first, "s", "left_semi")


def _possible() -> Column:
    """Whether sets may be similar whose first common shingle this is: it must leave room for all
    that they must have in common."""
    return (100 + SIMILAR) * F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= SIMILAR * (F.col("n") + F.col("n2"))


_OTHER = {"node": "node2", "n": "n2", "at": "at2", "label": "label2"}


def _open(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """index with the labels of components, without shingles that stand in one component only."""
    if labels is None:
        return index.withColumn("label", F.col("node"))
    labelled = index.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = labelled.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("s")
    return labelled.join(several, "s", "left_semi")


def _to_centres(index: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(u, v): each node with CENTRES nodes of other components drawn for each of its shingles."""
    rows = _open(index, labels)
    drawn = [F.struct(F.xxhash64("node", F.lit(turn), F.lit(k)).alias("luck"), *[F.col(a).alias(b) for a, b in _OTHER.items()]) for k in range(CENTRES // 2)]
    centres = rows.groupBy("s").agg(F.explode(F.array(*[f(x) for x in drawn for f in (F.min, F.max)])).alias("c")).select("s", *[f"c.{b}" for b in _OTHER.values()])
    return rows.join(centres, "s").where((F.col("label") != F.col("label2")) & _possible()).select(*_pairs("node", "node2"))


def _apart(index: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v): nodes of different components that share a shingle."""
    rows = _open(index, labels)
    other = rows.withColumnsRenamed(_OTHER)
    return rows.join(other, "s").where((F.col("label") < F.col("label2")) & _possible()).select(*_pairs("node", "node2"))


def near_copies(docs: DataFrame, keep: Scratch) -> DataFrame:
    """The key of each row of docs, node, and component, the same for all rows that links of near
    copies join."""
    texts = docs.select(*_key(docs), "text")
    rows = keep(prefixes(texts), "rows")
    # texts with equal sets are one node, told by one of its rows
    nodes = keep(rows.groupBy("node").agg(F.min(F.struct("id", "text_hash", "n", "fp", "bits")).alias("row")), "nodes")
    indexes = _indexes(rows, keep)
    tried = found = labels = None
    turn, draw, last = 0, True, False
    while not last:
        last = not draw
        pairs = reduce(DataFrame.union, [_to_centres(x, labels, turn) if draw else _apart(x, labels) for x in indexes])
        pairs = pairs.union(_by_fingerprint(nodes, keep)).distinct() if tried is None else pairs.distinct().join(tried, ["u", "v"], "left_anti")
        pairs = keep(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        more = _checked(pairs, texts, nodes, keep)
        found = more if found is None else found.union(more)
        labels = components(found, keep)
        turn += 1
        draw = turn < TURNS and YIELD * more.count() > pairs.count()
    return rows.select(*_KEY, "node").join(labels, "node", "left").select(*_KEY, F.coalesce("label", "node").alias("component"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies: that of the least doc_id (nulls last),
    then by hashes of the text and the other columns. Of rows equal throughout one stays."""
    with Scratch(docs.sparkSession, "near") as keep:
        rows = keep(near_copies(docs, keep).groupBy("component", *_KEY).agg(F.count("*").alias("copies")), "components")
        order = F.struct(F.col("id").isNull(), *_KEY)
        heads = rows.groupBy("component").agg(F.min(order).alias("head"))
        judged = rows.join(heads, "component").withColumn("kept", order == F.col("head"))
        # rows that go, and rows of which one of several equal ones stays
        marked = saved(judged.where("not kept or copies > 1").select(*[F.col(c).alias(f"_near_{c}") for c in _KEY], F.col("kept").alias("_near_kept")), "near-marked")
    # the row travels as one struct, where no name of its columns can clash
    keyed = docs.select(F.struct("*").alias("_row"), *_key(docs, "_key_"))
    same = F.col("_key_id").eqNullSafe(F.col("_near_id")) & (F.col("_key_text_hash") == F.col("_near_text_hash")) & (F.col("_key_rest_hash") == F.col("_near_rest_hash"))
    asked, others = thinned(keyed, [f"_key_{c}" for c in _KEY], marked, [f"_near_{c}" for c in _KEY])
    single = others.select("_row").union(asked.join(marked, same, "left_anti").select("_row"))
    several = asked.join(marked.where("_near_kept"), same, "left_semi").dropDuplicates([f"_key_{c}" for c in _KEY])
    return single.union(several.select("_row")).select("_row.*")
