"""Media columns: payloads as WAV files in a binary column, with spectral-peak pair fingerprints.

A payload is stored as the samples of a mono 8-bit WAV file, written and read with the wave
module. Its short-time Fourier transform (Hann window of FRAME samples, half overlapped) gives the
strongest bin of each band in each frame; peaks that rise above the band's mean make landmarks, and
each landmark is paired with those of the next frames. A pair is one code of both bins and their
distance, stored beside the time of its first frame: an array of (t, code).

Edge cases: null and empty texts give one frame of padding and no pairs; very long texts are
transformed in runs of frames, so memory is bounded by the text itself; repeated rows give equal
values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import shared_dir
from brindle.functions.shipping import ship
from brindle.llm.common import sliced, table

FRAME = 576
RATE = 8000
BANDS = ((4, 32), (32, 96), (96, 288))
AHEAD = 3
PEAK = 2.5
_RUN = 4096


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, band, bin) of the landmarks, in order of frame and band."""
    hop, window = FRAME // 2, np.hanning(FRAME).astype(np.float32)
    n = 1 + (len(samples) - FRAME) // hop
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::hop]
    out = []
    for low in range(0, n, _RUN):
        part = view[low : low + _RUN].astype(np.float32) - np.float32(128)
        power = np.abs(np.fft.rfft(part * window, axis=1))
        for band, (a, b) in enumerate(BANDS):
            best, mean = power[:, a:b].argmax(axis=1), power[:, a:b].mean(axis=1)
            strong = np.flatnonzero(power[np.arange(len(best)), a + best] > PEAK * mean + 1e-3)
            out.append(np.stack([low + strong, np.full(len(strong), band), a + best[strong]], axis=1))
    found = np.concatenate(out)
    return tuple(found[np.lexsort((found[:, 1], found[:, 0]))].T)


def pairs(samples: np.ndarray) -> list[tuple[int, int]]:
    """(t, code) for each landmark and each later one within AHEAD frames, in one band."""
    frame, band, bin_ = peaks(samples)
    out = []
    for b in range(len(BANDS)):
        f, k = frame[band == b], bin_[band == b]
        for step in range(1, AHEAD + 1):
            later = np.searchsorted(f, f + step)
            ok = np.flatnonzero((later < len(f)) & (f[np.minimum(later, len(f) - 1)] == f + step)) if len(f) else np.zeros(0, int)
            out.append(np.stack([f[ok], (k[ok] << 12) | (k[later[ok]] << 3) | step], axis=1))
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 1], found[:, 0]))].tolist()


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes doc_id, n_bytes and media (the WAV file of each whole text) as a Parquet table of
    the shared folder and returns it as read back."""
    spark = docs.sparkSession
    ship(spark)

    def wavs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            media = [to_wav(x + b"\xff" * (FRAME * max(1, -(-len(x) // FRAME)) - len(x))) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(wavs, "doc_id long, n_bytes long, media binary")
    path = folder or shared_dir(spark, "media")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


_LANDMARKS = pa.list_(pa.struct([("t", pa.int32()), ("code", pa.int32())]))


def features(stored: DataFrame) -> DataFrame:
    """Checks and fingerprints of the stored files: + payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and landmarks, an array of (t, code)."""
    ship(stored.sparkSession)
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "landmarks": _LANDMARKS}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for media in b.column(2).to_pylist():
                payload = from_wav(media)
                found = [{"t": t, "code": c} for t, c in pairs(np.frombuffer(payload, np.uint8))]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), found))
            made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc_id", "n_bytes", *kinds])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, landmarks array<struct<t:int,code:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature is landmarks as text, "t:code" in hexadecimal code, joined by blanks."""
    feature = F.concat_ws(" ", F.transform("landmarks", lambda x: F.concat(x["t"].cast("string"), F.lit(":"), F.lower(F.hex(x["code"])))))
    out = features(store(table(spark, sf_dir, "documents")))
    return out.select(*[c for c in out.columns if c != "landmarks"], feature.alias("feature"), "landmarks")
