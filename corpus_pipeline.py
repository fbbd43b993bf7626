"""The corpus pipeline: each stage works on all that the one before it kept.

Edge cases, for every stage: null and empty texts are rows like others until language ID rejects
them (they have no language); null, repeated and very large doc_ids are allowed, and rows that
share one but not the text are different documents; null sources form one source; repeated rows
are near copies, of which one stays; very long texts are used whole; an empty table gives an empty
one; further columns pass unchanged, whatever their names, up to packing, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scratch import delete, shared_dir, written
from brindle.llm import language_id, line_dedup, mixing, packing, simhash
from brindle.llm.token_store import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, brought up to date."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells with a margin; the others go."""
    return language_id.keep_identified(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on too many pages of their source."""
    return _counted(line_dedup.cleaned(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more): SimHash
    and its trees find the close ones, an exact join the rest."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, cut where a source's words run out."""
    return _counted(mixing.mixed_rows(docs).select("_row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written, and read by the next, after which
    the table before it goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline-{i}")
            docs = written(docs, path)
            if before:
                delete(spark, before)
            before = path
    return docs
