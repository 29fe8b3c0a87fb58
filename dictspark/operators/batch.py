"""Lookups of many keys at once (Spark-only extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictspark.operators.dictionary import Dictionary


def lookup(rows: DataFrame, d: Dictionary, key: str) -> DataFrame:
    """rows with the dictionary's value (null where the key is absent). No side is broadcast by order: Spark does so where its size is known to
    be small, and splits hot keys otherwise."""
    return rows.join(d.df.withColumnRenamed("key", key), key, "left")


def members(rows: DataFrame, d: Dictionary, key: str) -> DataFrame:
    return rows.join(d.df.select(F.col("key").alias(key)), key, "left_semi")


def strangers(rows: DataFrame, d: Dictionary, key: str) -> DataFrame:
    return rows.join(d.df.select(F.col("key").alias(key)), key, "left_anti")


def _with_cuts(rows: DataFrame, key: str, d: int) -> DataFrame:
    """rows of key and cut: the key and what is left of it after at most d deletions, a row for each way to delete."""
    out = rows.withColumn("cut", F.col(key))
    for _ in range(d):
        at = out.withColumn("i", F.explode(F.expr("sequence(0, length(cut))")))
        out = at.withColumn("cut", F.when(F.col("i") == 0, F.col("cut")).otherwise(F.expr("concat(left(cut, i - 1), substring(cut, i + 1))"))).drop("i")
    return out


def fuzzy_join(left: DataFrame, d: Dictionary, key: str, distance: int) -> DataFrame:
    """Pairs (key of left, dict_key, distance) within a Levenshtein distance of 1 or 2: two strings that near share a string after at most
    that many deletions in each, so an equi-join on deletions finds all, and the distance is then computed. The cuts are made in compiled
    code and those of the smaller side are summed up first, so that few of the other side's leave the join."""
    if distance not in (1, 2):
        raise ValueError("fuzzy_join takes a distance of 1 or 2")
    a = _with_cuts(left.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), key, distance).distinct()
    b = _with_cuts(d.df.select(F.col("key").alias("dict_key")), "dict_key", distance)
    near = F.abs(F.length(key) - F.length("dict_key")) <= distance
    pairs = b.join(a, "cut").where(near).select(key, "dict_key").distinct()
    return pairs.withColumn("distance", F.levenshtein(key, "dict_key", distance)).where("distance >= 0")
