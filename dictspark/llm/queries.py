"""The operators' queries: op{N}_{name} applies operator N with production parameters to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.llm import chat, decontam, langid, license, linedup, minhash, oracles, packing, shard, topk, warc
from dictspark.llm.common import OWN, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives to the shared folder, reads them back and assembles the captures."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(_table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.captures_of_pages(spark, path)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperMinHash; links at a similarity of 0.85, confirmed on the full sets."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


#: The base phrases that the contract of op3 names. (oracle_sql() has those of the operator, of which the first lacks "under".)
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, and templates contained to 0.8 in a block."""
    return license.scan_licenses(_table(spark, sf_dir, "documents"), phrases=BASE_PHRASES)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-parsing against suffix automata, one per language."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`, 16 shards, by sampled splitters."""
    return shard.shard_by_bytes(_table(spark, sf_dir, "documents"), 16)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the text without recurring templates."""
    out = linedup.drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(f"{OWN}lines").alias("n_lines"), F.col(f"{OWN}dropped").alias("n_dropped"), "text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 optimal length buckets; batches of 65,536 words."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best by integer inner product for the vectors whose id is divisible by 50."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations repaired at the least cost and rendered; long ones in parts. Actions as a list with commas."""
    return chat.format_chats(_table(spark, sf_dir, "conversations")).withColumn("actions", F.array_join("actions", ","))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight words; proximity within two positions as a further column."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=8, slop=2, min_items=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_warc, op2_near_duplicates, op3_license, op4_language, op5_sharding, op6_line_dedup, op7_packing, op8_topk, op9_chat, op10_decontamination)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """None for language ID, whose suffix automata are beyond SQL."""
    scan = oracles.licenses(license.TEMPLATES, license.PHRASES, license.THRESHOLD)
    packed = oracles.packing(16, 65_536, packing.CELL_ROWS)
    repaired = oracles.chats(chat.MOVES, chat.CLOSE, chat.ROLES, chat.ALIASES, chat.PART_TURNS, chat.INSERT)
    return {
        "op1_warc": oracles.WARC,
        "op2_near_duplicates": oracles.NEAR,
        "op3_license": scan,
        "op5_sharding": oracles.SHARDS,
        "op6_line_dedup": oracles.LINES,
        "op7_packing": packed,
        "op8_topk": oracles.TOP,
        "op9_chat": repaired,
        "op10_decontamination": oracles.CONTAMINATION,
    }
