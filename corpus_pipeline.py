"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Every stage takes all that its predecessor kept, is written as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dictspark.llm import decontam, langid, linedup, minhash, packing
from dictspark.llm.common import discard, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or without text) go, and so do those whose text the parse against all learned languages rejects. A document
    without a label gets the language found; labels stay. On a corpus without any usable label nothing is learned: all documents with a
    letter stay as they are."""
    return langid.keep_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go, but for the first document's; so do documents left without a word. n_chars, the
    length of the text, follows the text."""
    return linedup.without_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (linked at a similarity of 0.8 or more) stays: that with the smallest id."""
    return minhash.drop_near_duplicates(docs, num=80, den=100, bands=minhash.WIDE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight consecutive words of a benchmark item (a whole shorter item) go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' own columns and their places in length buckets and batches."""
    return packing.packed_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("packing", pack)]

#: Sketches, suffix automata and templates are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
