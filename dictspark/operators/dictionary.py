"""Ordered string dictionaries: a map (key, value) or a set (key), with unique keys, stored as Parquet in key order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.functions.strings import trimmed
from dictspark.operators.linesort import greatest_before
from dictspark.sources.text import parse_map_lines, parse_set_lines


@dataclass(frozen=True)
class Dictionary:
    """df has the column key and, for a map, value."""

    df: DataFrame

    @property
    def has_values(self) -> bool:
        return "value" in self.df.columns

    def save(self, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
        """Parquet, dealt by ranges of keys and sorted, so that key filters skip files and row groups. Small row groups make the skipping fine."""
        ranged = self.df.repartitionByRange(files, "key") if files else self.df.repartitionByRange("key")
        ranged.sortWithinPartitions("key").write.mode(mode).option("parquet.block.size", 16 << 20).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dictionary:
        df = spark.read.parquet(path)
        if "key" not in df.columns:
            raise ValueError(f"{path} holds no dictionary: it has the columns {df.columns}")
        return Dictionary(df)


def build_map(rows: DataFrame, key: str = "key", value: str = "value", order: Column | None = None) -> Dictionary:
    """One value per key. Of several, the one with the greatest order stands (the last inserted wins); without an order, the greatest value.
    Rows without a key are left out. One shuffle, with partial maxima before it."""
    order = F.col(value) if order is None else order
    rows = rows.where(F.col(key).isNotNull())
    return Dictionary(rows.groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(value), order).alias("value")))


def build_set(rows: DataFrame, key: str = "key") -> Dictionary:
    return Dictionary(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct())


def refused(rows: DataFrame, sort_key: Column, key: str = "key") -> DataFrame:
    """rows with refused: whether a builder that takes keys in ascending order only would refuse the row, coming in the order of sort_key. It
    refuses keys below the greatest before them, unless they are a prefix of that one; the empty key it takes only before all others."""
    seen = greatest_before(rows, key, sort_key)
    below = (F.col(key) < F.col("greatest")) & (~F.col("greatest").startswith(F.col(key)) | (F.col(key) == ""))
    return seen.withColumn("refused", F.coalesce(below, F.lit(False))).drop("greatest")


def _insertion(presorted: bool) -> Column:
    return F.struct(F.col("line_no")) if presorted else F.struct(trimmed(F.col("line")), F.col("line_no"))


def map_from_lines(lines: DataFrame, presorted: bool = False, strict: bool = False) -> Dictionary:
    """A map from text lines (line, line_no). Lines are inserted in the order of their trimmed text, so of lines with one key the textually
    greatest wins; presorted lines are inserted as they come. Ties go to the later line. strict leaves out what a builder of ascending
    keys would refuse (keys with leading white space, mostly, whose lines are ordered without it)."""
    rows, order = parse_map_lines(lines), _insertion(presorted)
    if strict:
        rows = refused(rows, order).where("NOT refused")
    return build_map(rows, order=order)


def set_from_lines(lines: DataFrame, presorted: bool = False, strict: bool = False) -> Dictionary:
    rows = parse_set_lines(lines)
    if strict:
        rows = refused(rows, _insertion(presorted)).where("NOT refused")
    return build_set(rows)
