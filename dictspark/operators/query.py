"""Queries over a dictionary: each is a filter (pushed to the scan where Parquet can) and an order by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictspark.operators.dictionary import Dictionary
from dictspark.operators.predicate import Always, Lev, Osa, Predicate, Prefix, Str


@dataclass(frozen=True)
class Bounds:
    """Limits of the keys. If both ge and gt are given, ge counts; likewise le before lt. None and the empty string set no limit."""

    ge: str | None = None
    gt: str | None = None
    le: str | None = None
    lt: str | None = None

    def column(self, key: Column) -> Column:
        out = F.lit(True)
        if self.ge or self.gt:
            out = out & (key >= self.ge if self.ge else key > self.gt)
        if self.le or self.lt:
            out = out & (key <= self.le if self.le else key < self.lt)
        return out


def filtered(d: Dictionary, predicate: Predicate | None = None, bounds: Bounds | None = None) -> DataFrame:
    """The keys within bounds that the predicate accepts, in no order."""
    key = F.col("key")
    return d.df.where((bounds or Bounds()).column(key) & (predicate or Always()).column(key))


def scan(d: Dictionary, predicate: Predicate | None = None, bounds: Bounds | None = None) -> DataFrame:
    """As filtered, in ascending bytewise order of keys."""
    return filtered(d, predicate, bounds).orderBy("key")


def match(d: Dictionary, text: str, bounds: Bounds | None = None) -> DataFrame:
    """The key equal to text, one row or none."""
    return filtered(d, Str(text), bounds).limit(1)


def prefix(d: Dictionary, text: str, bounds: Bounds | None = None) -> DataFrame:
    return scan(d, Prefix(text), bounds)


def range_(d: Dictionary, bounds: Bounds) -> DataFrame:
    return scan(d, None, bounds)


def fuzzy_predicate(text: str, distance: int, same_prefix: int = 0, damerau: bool = False) -> Predicate:
    near = (Osa if damerau else Lev)(text, distance)
    return Prefix(text[:same_prefix]) & near if same_prefix > 0 else near


def fuzzy(d: Dictionary, text: str, distance: int, same_prefix: int = 0, damerau: bool = False) -> DataFrame:
    """Keys within the distance of text; with same_prefix, only those that share that many first characters (at most all of text). The
    distance is over whole strings either way."""
    return scan(d, fuzzy_predicate(text, distance, same_prefix, damerau))


def hit_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("hits"))


def result_lines(rows: DataFrame) -> DataFrame:
    """line: a result as it is reported, [key]->[value], or [key] where there are no values."""
    key = F.concat(F.lit("["), F.col("key"), F.lit("]"))
    return rows.select((F.concat(key, F.lit("->["), F.col("value").cast("string"), F.lit("]")) if "value" in rows.columns else key).alias("line"))
