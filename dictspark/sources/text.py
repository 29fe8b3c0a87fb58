"""Text files: dictionary sources and line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.functions.strings import parse_uint64, split_fields


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, line_no. Lines end at U+000A alone, so carriage returns and blank lines stay. line_no rises with the place in the file: files
    are taken in order of their names, and within a file by the place of the block that holds the line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    where = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.select(F.col("value").alias("line"), where.alias("line_no"))


def parse_map_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """key and value (DECIMAL(20,0)) of lines `key,value[,more]`; empty lines and those with fewer than two fields are left out. Keys are not
    trimmed. Other columns stay."""
    fields = split_fields(F.col(line_col), ",")
    rows = lines.where((F.col(line_col) != "") & (F.size(fields) >= 2))
    return rows.withColumn("key", F.get(fields, F.lit(0))).withColumn("value", parse_uint64(F.get(fields, F.lit(1))))


def parse_set_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """key of lines `key[,more]`; empty lines are left out. Other columns stay."""
    return lines.where(F.col(line_col) != "").withColumn("key", F.get(split_fields(F.col(line_col), ","), F.lit(0)))


def line_report(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """One row: n_lines, n_empty, n_short (not empty, fewer than two fields), n_map (usable in a map), n_set (usable in a set)."""
    line, n = F.col(line_col), F.size(split_fields(F.col(line_col), ","))
    count = lambda c: F.count_if(c)
    return lines.agg(F.count("*").alias("n_lines"), count(line == "").alias("n_empty"), count((line != "") & (n < 2)).alias("n_short"), count((line != "") & (n >= 2)).alias("n_map"), count(line != "").alias("n_set"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_lines of the text files in path."""
    return spark.read.option("lineSep", "\n").text(path).agg(F.count("*").alias("n_lines"))
