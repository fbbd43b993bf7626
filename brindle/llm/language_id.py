"""Language ID by compression: a text belongs to the language whose dictionary compresses it best.

For each language slices of training texts, lower-cased, make one raw-content zstandard
dictionary. A text, lower-cased too, is encoded whole with every dictionary, segment by segment,
and the smallest total wins; where the runner-up is within a narrow margin the text is marked as
rejected. One set of compression parameters holds for texts of every length.

Training takes a bounded sample: for each language at most SAMPLE_DOCS different texts, the first
by a hash of the text among those not held out, and of each a slice of SLICE characters from a
place that the hash names; a dictionary holds at most DICTIONARY_BYTES. So the driver gets at most
SAMPLE_DOCS slices for each language, however often an id or a text is repeated.

Edge cases: null text and text without a letter give ``und``, score 0 and rejected; texts too short
to tell give the smallest all the same (ties go to the language with more training rows) and are
rejected when the margin is narrow; very long texts are encoded whole; without any training row all
texts are ``und``; repeated rows are scored alike; an empty table gives an empty result; other
columns are ignored or pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.shipping import ship
from brindle.llm.common import held_out, sliced, table

DICTIONARY_BYTES = 110_000
SAMPLE_DOCS = 366
SLICE = 300
SEGMENT = 16_384
#: Compression parameters beside the dictionary's.
LEVEL = 6
#: Least margin, (second - smallest) / second, for which a text is kept. On held-out rows of sf0.1
#: margins are 0 for some 0.5 % of texts, all but empty ones, and 0.018 or more for the rest.
MARGIN = 0.01
#: Margin at which the score is one half.
HALF = 0.05


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES, cut: int = SLICE) -> dict[str, bytes]:
    """language -> dictionary, from text and non-null lang of rows that are not held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the luck is the text's alone: however often a text is repeated, it is one draw
    luck = F.xxhash64("text", F.lit(7))
    counts = {r["lang"]: (r["n"], r["texts"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(luck).alias("texts")).collect()}
    if not counts:
        return {}
    # spares the sort most rows: about four times as many different texts as are needed go on, all
    # of them where there are fewer
    share = F.create_map(*[x for k, (_, n) in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * sample_docs / max(n, 1))))])
    near = known.select("lang", "text", luck.alias("luck")).where(F.pmod("luck", F.lit(1 << 30)) / float(1 << 30) <= share[F.col("lang")])
    start = F.pmod(F.hash("luck"), F.greatest(F.length("text") - cut, F.lit(0)) + 1) + 1
    drawn = near.select("lang", "luck", F.substring(F.col("text"), start, F.lit(cut)).alias("slice")).dropDuplicates(["lang", "luck"])
    ranked = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("luck"))).where(F.col("nth") <= sample_docs)
    rows = sorted(ranked.select("lang", "nth", "slice").collect())
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda k: (-counts[k][0], k)):
        data = b"\n".join(dict.fromkeys(r["slice"].lower().encode("utf-8", "surrogatepass") for r in rows if r["lang"] == lang))
        out[lang] = (data + b"\n")[:size]
    return out


def predict(docs: DataFrame, model: dict[str, bytes], carry: tuple[str, ...] = ("doc_id",), margin: float = MARGIN, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """carry + lang_pred, score and rejected, under the names given."""
    ship(docs.sparkSession)
    langs = list(model)
    text = F.col("text").alias("_text")
    schema = T.StructType(docs.select(*carry).schema.fields + [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def coder(dictionary: bytes):
            d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=SEGMENT, dict_size=DICTIONARY_BYTES, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress

        coders = [coder(model[x]) for x in langs]
        empty = len(coders[0](b"")) if langs else 0
        for b in sliced(batches):
            names_, scores, rejected = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                if t is None or not langs or not any(map(str.isalpha, t)):
                    names_.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                raw = t.lower().encode("utf-8", "surrogatepass")
                parts = [raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)]
                sizes = np.array([sum(len(c(p)) for p in parts) for c in coders]) - empty * len(parts)
                first = int(sizes.argmin())
                rest = np.delete(sizes, first)
                gap = float((rest.min() - sizes[first]) / max(rest.min(), 1)) if len(rest) else 1.0
                names_.append(langs[first])
                scores.append(gap / (gap + HALF))
                rejected.append(bool(gap < margin))
            new = [pa.array(names_, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*carry, *names])

    return docs.select(*carry, text).mapInArrow(score, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is told with a margin, as the model fitted on them says."""
    # all columns travel as one struct, where no name of theirs can clash
    out = predict(docs.select(F.struct("*").alias("_row"), "text"), fit(docs), ("_row",))
    return out.where("not rejected").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
