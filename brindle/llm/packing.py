"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into pieces of a whole sequence and a rest; a rest of more than half a
sequence is cut at the half, since longer pieces go ill together. Pieces fall into length classes;
the counts per class, a table of bounded size, go to the driver. There a linear program over patterns (multisets of classes that fit a sequence) is solved by column generation: the
duals of the present patterns price the classes, a knapsack dynamic program finds the pattern
worth most, and it enters while it is worth more than one sequence. The solution is rounded
down; the few pieces left over are packed best fit, longest first. On the executors pieces are
ranked within their class and take the pattern places of their rank.

Edge cases: null text is encoded as empty, so only its end id is packed; repeated rows are packed
once each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.shipping import ship
from brindle.llm.common import saved, sliced, table
from brindle.llm.encoding import encoder
from brindle.llm.token_store import tokenizer_path

SEQUENCE = 2048
#: Lengths that fall into one class; a piece is planned with its class's longest length.
WIDTH = 8
#: Stop generating when the sequences used are within this factor of the linear program's bound.
NEAR = 1.001
MOST_ROUNDS = 3000
#: Pieces that one task should rank; each class is ranked in as many parts as follow from it.
RANK_ROWS = 50_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of every document: whole sequences, then at most one half and a shorter rest."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for b in sliced(batches):
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(enc.encode(["" if t is None else t for t in b.column(1).to_pylist()])):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                whole = n // sequence * sequence
                cuts = [*range(0, whole, sequence), *range(whole, n, sequence // 2), n]
                for at, to in zip(cuts, cuts[1:], strict=False):
                    part = ids[4 * at : 4 * to]
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            doc = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def price(worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern worth most: a knapsack over classes 1..room with unlimited copies."""
    best, take = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    values = worth[: room + 1]
    for c in range(1, room + 1):
        options = best[c - 1 :: -1] + values[1 : c + 1]
        k = int(options.argmax())
        best[c], take[c] = (options[k], k + 1) if options[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(room + 1, dtype=np.int64), room
    while c > 0:
        if take[c]:
            pattern[take[c]] += 1
            c -= int(take[c])
        else:
            c -= 1
    return float(best[room]), pattern


def plan(counts: dict[int, int], room: int) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that pack counts[c] pieces of each class c in sequences of room units.

    pattern[c] is the number of pieces of class c. Every piece has its place and no place is
    left empty; patterns are used a whole number of times.
    """
    classes = sorted(c for c, n in counts.items() if n > 0)
    if not classes:
        return []
    demand = np.array([counts[c] for c in classes], dtype=float)
    where = np.array(classes)
    m = len(classes)
    columns = np.zeros((m, m))  # one pattern per class to begin with
    columns[np.arange(m), np.arange(m)] = [max(1, min(room // c, counts[c])) for c in classes]
    inverse = np.diag(1.0 / np.diag(columns))
    # equal ratios would let the simplex steps go round in circles
    aim = demand + np.random.default_rng(m).uniform(0.001, 0.01, m)
    x, bound = inverse @ aim, 0.0
    for _ in range(MOST_ROUNDS):
        duals = inverse.sum(axis=0)
        worth = np.zeros(room + 1)
        worth[where] = np.maximum(duals, 0)
        value, pattern = price(worth, room)
        bound = max(bound, x.sum() / max(value, 1.0))
        if x.sum() <= NEAR * bound:
            break
        column = pattern[where].astype(float)
        step = inverse @ column
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        x = np.maximum(x - step * ratio[out], 0)
        x[out] = ratio[out]
        columns[:, out] = column
        inverse[out] /= step[out]
        other = np.arange(m) != out
        inverse[other] -= np.outer(step[other], inverse[out])
    left, out_plan = demand.astype(np.int64), []
    for i in np.argsort(-x):
        pattern = np.zeros(room + 1, dtype=np.int64)
        pattern[where] = columns[:, i].astype(np.int64)
        fits = min((left[j] // pattern[c] for j, c in enumerate(classes) if pattern[c]), default=0)
        times = min(int(x[i] + 1e-9), int(fits))
        if times > 0:
            out_plan.append((times, pattern))
            left -= times * pattern[where]
    return out_plan + _best_fit({c: int(n) for c, n in zip(classes, left, strict=True) if n}, room)


def _best_fit(counts: dict[int, int], room: int) -> list[tuple[int, np.ndarray]]:
    """Best fit, longest first; what rounding leaves is a few pieces for each pattern."""
    by_room: dict[int, list[np.ndarray]] = {}
    for c in sorted(counts, reverse=True):
        for _ in range(counts[c]):
            fit = min((r for r in by_room if r >= c and by_room[r]), default=None)
            pattern = by_room[fit].pop() if fit is not None else np.zeros(room + 1, dtype=np.int64)
            pattern[c] += 1
            by_room.setdefault((fit if fit is not None else room) - c, []).append(pattern)
    alike: dict[bytes, list] = {}
    for patterns in by_room.values():
        for p in patterns:
            alike.setdefault(p.tobytes(), [0, p])[0] += 1
    return [(n, p) for n, p in alike.values()]


def places(planned: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each class, rows (first rank, pieces in a pattern, first sequence, first place)."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in planned:
        place = 0
        for c in np.flatnonzero(pattern)[::-1].tolist():
            n = int(pattern[c])
            out.setdefault(c, []).append((used.get(c, 0), n, sequence, place))
            used[c] = used.get(c, 0) + times * n
            place += n
        sequence += times
    return {c: np.array(rows, dtype=np.int64) for c, rows in out.items()}


def assign(cut: DataFrame, sequence: int = SEQUENCE, width: int = WIDTH) -> DataFrame:
    """pieces (a written table) -> + sequence_id and offset."""
    room = sequence // width
    order = [F.asc_nulls_first("doc_id"), "start", "doc_tokens", "ids_crc32"]
    rank_parts = -(-cut.count() // RANK_ROWS) or 1
    cut = cut.withColumn("_class", F.ceil(F.col("length") / width).cast("int")).withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(rank_parts)).cast("int"))
    parts = saved(cut.groupBy("_class", "_part").agg(F.count("*").alias("_n")), "pack-counts")
    # one row per class, at most sequence / width of them
    counts = {r["_class"]: r["n"] for r in parts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    at = places(plan(counts, room))

    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(parts.select("_class", "_part", before.alias("_before")), ["_class", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_class", "_part").orderBy(*order)) - 1)

    @F.pandas_udf("sequence_id long, place long")
    def seat(cls: pd.Series, rank: pd.Series) -> pd.DataFrame:
        cls, rank = cls.to_numpy(), rank.to_numpy()
        sequence_id, place = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        for c in np.unique(cls).tolist():
            rows, mine = at[c], np.flatnonzero(cls == c)
            found = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
            nth = rank[mine] - found[:, 0]
            sequence_id[mine] = found[:, 2] + nth // found[:, 1]
            place[mine] = found[:, 3] + nth % found[:, 1]
        return pd.DataFrame({"sequence_id": sequence_id, "place": place})

    ship(cut.sparkSession)
    seated = ranked.withColumn("_seat", seat("_class", "_rank"))
    running = Window.partitionBy("_seat.sequence_id").orderBy("_seat.place").rowsBetween(Window.unboundedPreceding, -1)
    return seated.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("_seat.sequence_id").alias("sequence_id"), F.coalesce(F.sum("length").over(running), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return assign(saved(pieces(docs, tokenizer, end_id, sequence), "pack-pieces"), sequence, width)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
