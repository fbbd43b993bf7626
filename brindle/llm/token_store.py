"""Token ids in binary shard files, found by document key through a minimal perfect hash.

A shard file holds, little-endian: an 8-byte mark, the header's length (u64), the header (JSON:
the sections' types, lengths and offsets), and the sections. ``ids`` is the raw payload (u16
where the vocabulary allows, else u32), documents one after another in ascending key order;
``starts`` has each document's first id. The perfect hash maps a key to a slot; ``ordinal``,
``copies`` and ``fingerprint`` of the slot give the document and reject unknown keys, so a lookup
reads a few words of index and then one run of ids.

Files are written by range-partitioned tasks under names of their own attempt; the manifest
names those of the attempts that counted, so a task can be lost and run again. A key that many
rows share spreads over tasks by a hash of the text, and a task writes a further shard as soon as
one is full.

Reading many keys deals them to the shards that may hold them (a join by bins that a bounded number
of marks among the shards' first keys make), reads each shard's index once, asks its hash for the
documents, and reads neighbouring documents in one run. A single lookup reads only the words that
the hash leads to: some 100 bytes beside the header, whatever the shard's size.

The keys are stored as well, so that a store can list what it holds (``stored_keys``); a lookup
never reads them, the fingerprint tells an unknown key from a known one but for one in 2^32.

Edge cases: null text is encoded as empty, so only the end id is stored; null keys come first
and are found by key None; rows with one key are stored side by side (in order of a hash of the
text) and found together; very long texts are stored whole; an empty table gives no shards and no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch, shared_dir
from brindle.functions.shipping import ship
from brindle.llm import perfect_hash
from brindle.llm.common import saved, sliced, table
from brindle.llm.encoding import encoder
from brindle.operators.ordering import numbered

MARK = b"BRTOKEN1"
SHARD_BYTES = 16 << 20
#: Ids and documents beyond which a task begins a further shard.
FULL_IDS, FULL_DOCS = 16 << 20, 1 << 19
#: Marks among the shards' first keys by which keys are dealt to shards.
MARKS = 4096
#: Ids that one read takes at most.
READ_IDS = 1 << 20


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def pack_shard(keys: np.ndarray, valid: np.ndarray, ids: list[bytes], wide: bool) -> tuple[bytes, list[memoryview]]:
    """The head and the sections of a shard; ids are u32 bytes for each document, keys ascend."""
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<i8")
    payload = np.frombuffer(b"".join(ids), dtype="<u4").astype("<u4" if wide else "<u2")
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (valid[1:] != valid[:-1])]) & valid if len(keys) else np.zeros(0, bool)
    ordinals = np.flatnonzero(first)
    unique = keys[ordinals].astype(np.int64).view(np.uint64)
    index = perfect_hash.build(unique)
    at = perfect_hash.slots(index, unique)
    n = len(unique)
    ends = np.append(ordinals[1:], len(keys)) if n else ordinals
    by_slot = {"ordinal": np.zeros(n, "<i8"), "copies": np.zeros(n, "<i8"), "fingerprint": np.zeros(n, "<u4")}
    by_slot["ordinal"][at], by_slot["copies"][at], by_slot["fingerprint"][at] = ordinals, ends - ordinals, perfect_hash.fingerprint(unique)
    parts = {"keys": keys.astype("<i8"), "valid": valid.astype("u1"), "starts": starts, **index, **by_slot, "ids": payload}
    sections, offset = {}, 0
    for name, x in parts.items():
        sections[name] = [x.dtype.str, len(x), offset]
        offset += x.nbytes
    head = json.dumps(sections).encode()
    return MARK + len(head).to_bytes(8, "little") + head, [memoryview(np.ascontiguousarray(x)).cast("B") for x in parts.values() if len(x)]


class _Remote:
    """A section whose numbers are read one by one, as they are asked for."""

    def __init__(self, shard: Shard, name: str):
        self.shard, self.name = shard, name

    def __getitem__(self, at) -> np.ndarray:
        kind = np.dtype(self.shard.sections[self.name][0])
        found = [self.shard._section(self.name, i, i + 1)[0] for i in np.atleast_1d(at).tolist()]
        return np.array(found, kind) if np.ndim(at) else found[0]


class Shard:
    """A shard file, open for reading, ids as they are asked for. For many keys the index is read at
    once; for a few (``whole`` false) only the words that their hash leads to."""

    def __init__(self, uri: str, whole: bool = True):
        files, path = _files(uri)
        self.file, self.n_read = files.open_input_file(path), 0
        if self._bytes(8, 0) != MARK:
            raise ValueError(f"{uri} is no token shard")
        n = int.from_bytes(self._bytes(8, 8), "little")
        self.sections, self.base = json.loads(self._bytes(n, 16)), 16 + n
        self.index = {k: self._section(k) if whole or k == "sizes" else _Remote(self, k) for k in self.sections if k != "ids"}

    def _bytes(self, n: int, at: int) -> bytes:
        self.n_read += n
        return self.file.read_at(n, at)

    def _section(self, name: str, low: int = 0, high: int | None = None) -> np.ndarray:
        kind, n, offset = self.sections[name]
        kind, high = np.dtype(kind), n if high is None else high
        return np.frombuffer(self._bytes((high - low) * kind.itemsize, self.base + offset + low * kind.itemsize), dtype=kind)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for unknown keys."""
        keys = keys.astype(np.int64).view(np.uint64)
        at = perfect_hash.slots(self.index, keys)
        ok = np.flatnonzero(at >= 0)
        at[ok[self.index["fingerprint"][at[ok]] != perfect_hash.fingerprint(keys[ok])]] = -1
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ordinal of each key's first document, -1 for unknown keys."""
        at = self.slots(keys)
        out = np.full(len(keys), -1, np.int64)
        out[at >= 0] = self.index["ordinal"][at[at >= 0]]
        return out

    def ordinals(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal, which key) of every document with one of the keys."""
        at = self.slots(keys)
        known = np.flatnonzero(at >= 0)
        copies = self.index["copies"][at[known]]
        which = np.repeat(known, copies)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
        return self.index["ordinal"][at[which]] + nth, which

    def unkeyed(self) -> np.ndarray:
        """The ordinals of the documents without a key."""
        return np.flatnonzero(self.index["valid"] == 0)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key."""
        found = self.unkeyed() if key is None else self.ordinals(np.array([key]))[0]
        return [self.ids(int(i)) for i in found]

    def ids(self, ordinal: int) -> np.ndarray:
        return self._section("ids", int(self.index["starts"][ordinal]), int(self.index["starts"][ordinal + 1]))

    def crcs(self, ordinals: np.ndarray) -> np.ndarray:
        """crc32 of the u32 ids of each document; ordinals ascend, and neighbours are read in one run."""
        starts, out = self.index["starts"], np.zeros(len(ordinals), np.int64)
        lows, highs = starts[ordinals].tolist(), starts[ordinals + 1].tolist()
        i = 0
        while i < len(lows):
            j = i + 1
            while j < len(lows) and lows[j] == highs[j - 1] and highs[j] - lows[i] <= READ_IDS:
                j += 1
            if j == i + 1:  # alone, and perhaps long
                crc = 0
                for at in range(lows[i], highs[i], READ_IDS):
                    crc = zlib.crc32(self._section("ids", at, min(highs[i], at + READ_IDS)).astype("<u4").tobytes(), crc)
                out[i] = crc
            else:
                run = memoryview(self._section("ids", lows[i], highs[j - 1]).astype("<u4").tobytes())
                for k in range(i, j):
                    out[k] = zlib.crc32(run[4 * (lows[k] - lows[i]) : 4 * (highs[k] - lows[i])])
            i = j
        return out


_MANIFEST = "shard long, uri string, n_docs long, n_null long, n_ids long, first_key long, last_key long"
_KINDS = pa.schema([("shard", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes doc_id, text into shard files in ascending doc_id order and returns the manifest,
    one row per shard with base, the number of ids in the shards before it."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_dir(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        part, made = TaskContext.get().partitionId(), 0
        keys, valid, ids, held = [], [], [], 0

        def full() -> pa.RecordBatch:
            uri = f"{folder}/shard-{part:06d}-{made:04d}-{uuid.uuid4().hex}.tokens"
            k, v = np.array(keys, dtype=np.int64), np.array(valid, dtype=bool)
            head, sections = pack_shard(k, v, ids, wide=enc.n_ids > 1 << 16 or end_id >= 1 << 16)
            files, path = _files(uri)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            with files.open_output_stream(path) as out:
                out.write(head)
                for p in sections:
                    out.write(p)
            known = k[v].tolist()
            row = {"shard": (part << 20) + made, "uri": uri, "n_docs": len(k), "n_null": int((~v).sum()), "n_ids": held, "first_key": known[0] if known else None, "last_key": known[-1] if known else None}
            return pa.RecordBatch.from_pylist([row], schema=_KINDS)

        for b in sliced(batches):
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            for key, x in zip(b.column(0).to_pylist(), enc.encode(texts), strict=True):
                keys.append(0 if key is None else key)
                valid.append(key is not None)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= FULL_IDS or len(ids) >= FULL_DOCS:
                    yield full()
                    made, held = made + 1, 0
                    keys, valid, ids = [], [], []
        if ids:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_h")]
    ordered = rows.repartitionByRange(int(n), *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = saved(ordered.mapInArrow(shards, _MANIFEST), "token-manifest")
    with Scratch(spark, "token-bases") as keep:
        based = numbered(manifest, ["shard"], keep, "_nth", {"base": "n_ids"})
        return saved(based.drop("_nth").withColumn("base", F.col("base").cast("long")), "token-shards")


def stored_keys(manifest: DataFrame) -> DataFrame:
    """doc_id of all that is stored, as the shards list it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                index = Shard(uri).index
                yield pa.RecordBatch.from_arrays([pa.array(index["keys"], pa.int64(), mask=index["valid"] == 0)], names=["doc_id"])

    ship(manifest.sparkSession)
    return manifest.select("uri").mapInArrow(each, "doc_id long")


def read(manifest: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document stored under the doc_ids of keys (all
    that are stored, by default), each found through its shard's index; unknown keys give no row."""
    # some of the shards' first keys mark out bins; keys meet the shards that reach into their bin
    keyed = manifest.where("first_key is not null")
    every = max(1, -(-keyed.count() // MARKS))
    drawn = keyed.where(F.pmod(F.xxhash64("shard"), F.lit(every)) == 0).select("first_key").distinct().limit(4 * MARKS)
    marks = np.unique(drawn.toArrow().column(0).to_numpy().astype(np.int64))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(marks, b.column(0).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at)], names=["doc_id", "bin"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = (np.searchsorted(marks, b.column(i).to_numpy(), side="right") for i in (1, 2))
            which = np.repeat(np.arange(b.num_rows), high - low + 1)
            bin_ = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(which)) for c in b.columns), pa.array(bin_)], names=["shard", "first_key", "last_key", "bin"])

    def documents(asked: pa.Table) -> pa.Table:
        found, base = Shard(asked["uri"][0].as_py()), asked["base"][0].as_py()
        known = pa.compute.drop_null(asked["doc_id"]).to_numpy()
        ordinals, which = found.ordinals(known)
        mine = pa.array(known[which], pa.int64())
        if len(known) < asked.num_rows:
            more = found.unkeyed()
            ordinals, mine = np.concatenate([ordinals, more]), pa.concat_arrays([mine, pa.nulls(len(more), pa.int64())])
        order = np.argsort(ordinals)
        ordinals, mine = ordinals[order], mine.take(pa.array(order))
        starts = found.index["starts"]
        return pa.table({"doc_id": mine, "start": pa.array(starts[ordinals] + base), "n_tokens": pa.array(starts[ordinals + 1] - starts[ordinals]), "ids_crc32": pa.array(found.crcs(ordinals))})

    ship(manifest.sparkSession)
    keys = stored_keys(manifest) if keys is None else keys.select(F.col("doc_id").cast("long").alias("doc_id"))
    keys = keys.distinct()
    known = keys.where("doc_id is not null").mapInArrow(bins, "doc_id long, bin long")
    shards = keyed.select("shard", "first_key", "last_key").mapInArrow(reach, "shard long, first_key long, last_key long, bin long")
    dealt = known.join(shards, (known["bin"] == shards["bin"]) & known["doc_id"].between(shards["first_key"], shards["last_key"])).select("doc_id", "shard")
    # the null key is in every shard that has rows without a key
    nulls = manifest.where("n_null > 0").select("shard", F.pmod("shard", F.lit(1)).alias("none")).join(keys.where("doc_id is null").select(F.coalesce("doc_id", F.lit(0)).alias("none")), "none", "left_semi")
    dealt = dealt.unionByName(nulls.select(F.lit(None).cast("long").alias("doc_id"), "shard"))
    return dealt.join(manifest.select("shard", "uri", "base"), "shard").groupBy("shard").applyInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, key: int | None) -> list[np.ndarray]:
    """The ids of the documents with a key: one manifest row or two, a few words of each shard's index,
    and one read of ids each. Without a key, the marks of all rows are read."""
    where = F.col("n_null") > 0 if key is None else (F.lit(key) <= F.col("last_key")) & (F.lit(key) >= F.col("first_key"))
    return [x for r in manifest.where(where).orderBy("shard").toLocalIterator() for x in Shard(r["uri"], whole=key is None).get(key)]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read(write(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2), docs.select("doc_id"))
