"""String functions of the dictionary engine as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that trimming removes, and the largest unsigned 64-bit integer.
TRIM_SET = " \t\r\n"
UINT64_MAX = (1 << 64) - 1


def trimmed(text: Column) -> Column:
    """Without spaces, tabs, carriage returns and line feeds at both ends; other white space stays."""
    return F.trim(text, F.lit(TRIM_SET))


def split_fields(text: Column, separator: str, ignore_empty: bool = False) -> Column:
    """Fields between literal separators, empty ones at the end too."""
    parts = F.split(text, re.escape(separator))
    return F.filter(parts, lambda x: x != "") if ignore_empty else parts


def characters(text: Column) -> Column:
    """The text's code points as an array of strings."""
    return F.regexp_extract_all(text, F.lit("((?s).)"))


def utf8_lengths(text: Column) -> Column:
    """Bytes of each character in UTF-8."""
    return F.transform(characters(text), lambda c: F.octet_length(c))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def parse_uint64(text: Column) -> Column:
    """An unsigned 64-bit number as DECIMAL(20,0), read as C++ streams read one: white space before it is skipped, reading stops at the
    first character that is no digit, no digits give 0, too many give the largest number, and a minus sign wraps around modulo 2^64."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    digits = F.regexp_replace(F.regexp_replace(found, r"^[+-]", ""), r"^0+(?=[0-9])", "")
    top = F.lit(str(UINT64_MAX)).cast("decimal(20,0)")
    size = F.when(F.length(digits) > 20, top).otherwise(F.least(_decimal(digits), top.cast("decimal(21,0)")).cast("decimal(20,0)"))
    over = (F.length(digits) > 20) | (_decimal(digits) > top)
    wrapped = (F.lit(str(UINT64_MAX + 1)).cast("decimal(21,0)") - size).cast("decimal(20,0)")
    return F.when(digits == "", F.lit(0).cast("decimal(20,0)")).when(found.startswith("-") & ~over & (size > 0), wrapped).otherwise(size)


def _decimal(digits: Column) -> Column:
    return F.coalesce(F.when(F.length(digits) <= 20, digits).try_cast("decimal(21,0)"), F.lit(0).cast("decimal(21,0)"))
