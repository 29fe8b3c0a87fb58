"""Hashes, times and random text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(key: Column) -> Column:
    """A 64-bit hash of a value of any type; equal values have equal hashes."""
    return F.xxhash64(key)


def combined_hash(*parts: Column) -> Column:
    """A 64-bit hash of several values; their order counts."""
    return F.xxhash64(*parts)


def readable_time(at: Column) -> Column:
    """yyyyMMddHHmmss in the session's time zone."""
    return F.date_format(at, "yyyyMMddHHmmss")


def random_text(length: int, seed: int) -> Column:
    """Random letters and digits, other ones in each row; the same for the same seed and partitions."""
    return F.randstr(F.lit(length), seed)


def valid_utf8(data: Column) -> Column:
    """Whether bytes are whole UTF-8 characters."""
    return F.is_valid_utf8(data)
