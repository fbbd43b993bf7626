"""Substring dedup: passages of LENGTH words or more that an earlier document holds are removed.

Level-wise doubling. Windows of FIRST words are counted first; only those that occur again are
extended to twice that length, and so on, until none is left or LENGTH is reached (a longer
repeated window is made of repeated windows of LENGTH, so going on would remove nothing more).
On the way up not every window is counted: each window of LENGTH words has one anchor, its window
of FIRST words of least hash (the leftmost of equals), which is the same wherever the passage
stands. Anchors that occur once rule out all windows that hang on them; the others are extended,
to the right or to the left, whichever stays within the window of LENGTH.

The levels below LENGTH count 64-bit keys and pass on a bounded bitmap of the repeated ones: a key
too many costs a row further up and changes nothing. At LENGTH the keys are 128 bits of the word
sequence; each key's smallest doc_id is its owner, and a document loses the candidate windows that
it doesn't own. What travels is a key and a number for each candidate; documents meet the list of
keys that they own, which is no longer than the document.

Edge cases: null and empty texts and texts of fewer words than LENGTH lose nothing; a passage
repeated inside one document alone stays; of copies the smallest doc_id stays whole; rows that
share a doc_id don't count as earlier for each other (the windows of all of them meet in one list);
a row without a doc_id loses nothing and takes nothing from others; repeated rows give repeated
rows; very long texts are used whole; an empty table gives an empty result; further columns pass
unchanged, whatever their names, in ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.scratch import Scratch
from brindle.functions.shipping import ship
from brindle.llm.common import WORD, saved, sliced, table
from brindle.llm.sketches import bitmap, has, paired

LENGTH = 13
FIRST = 4
#: Different words that a worker keeps hashes of.
WORDS_KEPT = 500_000


class WordHashes(dict):
    """word -> 16 bytes; forgets all when full."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        out = self[word] = xxhash.xxh3_128_digest(word)
        return out


def levels(length: int = LENGTH, first: int = FIRST) -> list[int]:
    """first, twice that, and so on, up to length."""
    out = [min(first, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


class Windows:
    """The windows of some texts by two 64-bit lanes; positions run over all their words."""

    def __init__(self, words: list[list[bytes]], hashes: WordHashes, sizes: list[int]):
        self.lanes = np.frombuffer(b"".join([hashes[w] for ws in words for w in ws]), np.uint64).reshape(-1, 2)
        self.doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
        self.sizes, self.known = sizes, {}

    def keys(self, size: int, lane: int = 0) -> np.ndarray:
        """Keys of the windows of a size (1, a power of two below the first, or one of sizes) that
        start at each word, each from two windows of the size before."""
        if size == 1:
            return np.ascontiguousarray(self.lanes[:, lane])
        if (size, lane) not in self.known:
            half = max([n for n in self.sizes if n < size] or [1 << (size - 1).bit_length() - 1])
            x = self.keys(half, lane)
            self.known[size, lane] = paired(x[: len(x) - (size - half)], x[size - half :])
        return self.known[size, lane]


def _read(texts: list, hashes: WordHashes, sizes: list[int]) -> tuple[list[list[bytes]], Windows]:
    words = [[] if t is None else t.split() for t in texts]
    return words, Windows(words, hashes, sizes)


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the least of the next ``width`` numbers, the leftmost of equals."""
    at, size = np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        right = x[step:] < x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at


def _candidates(win: Windows, bits: list[np.ndarray], whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows of the longest size that the bitmaps leave, start of the next size's
    window that speaks for each), bitmaps standing for the sizes from the first on."""
    length, first = win.sizes[-1], win.sizes[0]
    if len(win.doc) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = win.doc[: len(win.doc) - length + 1] == win.doc[length - 1 :]
    if whole is not None:
        inside &= whole[win.doc[: len(inside)]]
    starts = np.flatnonzero(inside)
    anchor = leftmost_least(win.keys(first), length - first + 1)[starts]
    at = anchor
    for i, b in enumerate(bits):
        keep = has(b, win.keys(win.sizes[i])[at])
        starts, anchor = starts[keep], anchor[keep]
        if i + 1 == len(win.sizes):
            return starts, starts
        # to the right of the anchor while that stays within the window, else to its left
        more = win.sizes[i + 1]
        at = np.where(anchor + more <= starts + length, anchor, np.maximum(starts, anchor + first - more))
    return starts, at


def _level(docs: DataFrame, sizes: list[int], bits: list[np.ndarray]) -> DataFrame:
    """(key, n): candidates of level len(bits), counted within a task."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches):
            _, win = _read(b.column(0).to_pylist(), hashes, sizes)
            _, at = _candidates(win, shared.value)
            if len(at):
                keys, n = np.unique(win.keys(sizes[len(shared.value)])[np.unique(at)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select(F.col("_text")).mapInArrow(run, "key long, n long")


def _owned(docs: DataFrame, sizes: list[int], bits: list[np.ndarray]) -> DataFrame:
    """(key_a, key_b, _owner) of candidate windows of the full length."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches):
            _, win = _read(b.column(1).to_pylist(), hashes, sizes)
            starts, _ = _candidates(win, shared.value)
            if len(starts):
                ids = b.column(0).take(pa.array(win.doc[starts]))
                yield pa.RecordBatch.from_arrays([*(pa.array(win.keys(sizes[-1], i)[starts].view(np.int64)) for i in (0, 1)), ids], names=["key_a", "key_b", "_owner"])

    found = docs.where("_id is not null").select("_id", "_text").mapInArrow(run, "key_a long, key_b long, _owner long")
    return found.groupBy("key_a", "key_b").agg(F.min("_owner").alias("_owner"))


def _owns(lists: pa.ListArray, win: Windows, starts: np.ndarray) -> np.ndarray:
    """Whether each window is in its document's list of keys."""
    doc, a, b = win.doc[starts], win.keys(win.sizes[-1])[starts], win.keys(win.sizes[-1], 1)[starts]
    flat = lists.flatten()
    of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    key_a, key_b = (flat.field(i).to_numpy().view(np.uint64) for i in (0, 1))
    if not len(of):
        return np.zeros(len(starts), bool)
    # found by a mixed key, compared in full
    mix, mine = paired(key_a, key_b + of.astype(np.uint64)), paired(a, b + doc.astype(np.uint64))
    order = np.argsort(mix)
    at = order[np.minimum(np.searchsorted(mix, mine, sorter=order), len(mix) - 1)]
    same = (of[at] == doc) & (key_a[at] == a) & (key_b[at] == b)
    if (same != (mix[at] == mine)).any() or (mix[order][1:] == mix[order][:-1]).any():
        known = set(zip(of.tolist(), key_a.tolist(), key_b.tolist(), strict=True))
        same = np.array([x in known for x in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True)])
    return same


def _covered(win: Windows, starts: np.ndarray) -> np.ndarray:
    """Whether each word lies in one of the windows."""
    edge = np.zeros(len(win.doc) + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + win.sizes[-1], -1)
    return np.cumsum(edge)[:-1] > 0


def _removed(joined: DataFrame, sizes: list[int], bits: list[np.ndarray] | None, schema: T.StructType) -> DataFrame:
    """_row, n_words, n_removed, the kept words joined by a space and its sha256; without bitmaps no
    window is a candidate."""
    shared = joined.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches):
            words, win = _read(b.column(1).to_pylist(), hashes, sizes)
            with_id = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            starts, _ = _candidates(win, shared.value, with_id) if shared.value is not None else (np.zeros(0, np.int64), None)
            if len(starts):
                starts = starts[~_owns(b.column(3), win, starts)]
            gone = _covered(win, starts)
            ends = np.cumsum([len(w) for w in words])
            texts, n_gone = [], []
            for ws, end in zip(words, ends.tolist(), strict=True):
                mine = gone[end - len(ws) : end]
                n_gone.append(int(mine.sum()))
                texts.append(b" ".join([w for w, g in zip(ws, mine.tolist(), strict=True) if not g] if n_gone[-1] else ws))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(n_gone, pa.int64()), pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                schema=pa.schema([pa.field("_row", b.column(0).type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("_kept", pa.binary()), ("kept_sha256", pa.string())]),
            )

    return joined.mapInArrow(run, schema)


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, first: int = FIRST, name: str = "_removal", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The carried columns of docs (all of them, unless named) + a struct column ``name`` of n_words, n_removed, kept (the words left, joined by one
    space) and kept_sha256. What the result reads is written to the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    sizes, bits, left = levels(length, first), [], True
    carried = docs.select(*(docs.columns if carry is None else carry)).schema
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried.names]).alias("_row"), F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    with Scratch(spark, "substring") as keep:
        for n in sizes[:-1]:
            counts = _level(rows, sizes, bits).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
            found = bitmap(keep(counts, f"windows-{n}"), "key")
            if found is None:
                left = False
                break
            bits.append(found)
        if left:
            # the windows that a document owns; candidates without a second place own themselves
            owned = saved(_owned(rows, sizes, bits).groupBy("_owner").agg(F.collect_list(F.struct("key_a", "key_b")).alias("_keys")), "substring-owned")
        else:
            owned = spark.createDataFrame([], "_owner long, _keys array<struct<key_a:bigint,key_b:bigint>>")
    joined = rows.join(owned, F.col("_id") == F.col("_owner"), "left").select("_row", "_text", "_id", "_keys")
    schema = T.StructType([T.StructField("_row", carried), *T.StructType.fromDDL("n_words long, n_removed long, _kept binary, kept_sha256 string").fields])
    done = _removed(joined, sizes, bits if left else None, schema)
    out = F.struct("n_words", "n_removed", F.col("_kept").cast("string").alias("kept"), "kept_sha256")
    return done.select("_row.*", out.alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs, carry=("doc_id",)).select("doc_id", "_removal.n_words", "_removal.n_removed", "_removal.kept_sha256")


def oracle() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + {LENGTH - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {LENGTH - 2})) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
r AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + {LENGTH})) AS j FROM w JOIN f USING (k) WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(js, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""
