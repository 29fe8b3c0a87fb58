"""Streams against a dictionary (Spark-only extension; the dictionary is static)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dictspark.operators.batch import lookup, members
from dictspark.operators.dictionary import Dictionary


def enriched(stream: DataFrame, d: Dictionary, key: str, only_members: bool = False) -> DataFrame:
    """A stream's rows with the dictionary's value, or only the rows whose key it holds: stateless, so any output mode will do."""
    return members(stream, d, key) if only_members else lookup(stream, d, key)
