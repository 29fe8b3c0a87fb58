"""Stable sorting of line files by trimmed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dictspark.functions.strings import trimmed
from dictspark.sources.text import read_lines
from dictspark.storage import stored


def sort_lines(lines: DataFrame, keep_empty: bool = True, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """Lines in order of their text without spaces, tabs and line ends at both sides; equal ones in their given order, all of them, as they
    were. Without keep_empty, lines of such white space alone are left out. One range shuffle; the sort spills."""
    key = trimmed(F.col(line_col))
    rows = lines if keep_empty else lines.where(key != "")
    return rows.orderBy(key, order_col)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place (from 1), their place in the given order, as a stored table: dealt into ranges by one shuffle, sorted and numbered within
    each. One number per range goes to the driver."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    own = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")  # the range in its upper bits, the place within in its lower 33
    which, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = dict(own.groupBy(which.cast("int")).count().collect())
    before, total = [], 0
    for r in range(ranges):
        before.append(total)
        total += sizes.get(r, 0)
    return own.withColumn("place", within + 1 + F.get(F.lit(before), which.cast("int"))).drop("__at")


def place_lines(lines: DataFrame, keep_empty: bool = True, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """lines with place (from 1), their place in the sorted file, without ordering everything in one task."""
    key = trimmed(F.col(line_col))
    return ranked(lines if keep_empty else lines.where(key != ""), key, F.col(order_col))


def greatest_before(rows: DataFrame, value: str, sort_key: Column) -> DataFrame:
    """rows with greatest: the greatest value of the rows before in the order of sort_key, null for the first. Rows are taken in ranges of that
    order; one value per range goes to the driver."""
    every = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = ranked(rows, sort_key)
    total = placed.count()
    ranged = placed.withColumn("__range", F.floor((F.col("place") - 1) * every / F.lit(max(1, total))).cast("int"))
    top = dict(ranged.groupBy("__range").agg(F.max(value)).collect())
    before, most = [], None
    for r in range(every):
        before.append(most)
        most = max((x for x in (most, top.get(r)) if x is not None), key=lambda x: x.encode(), default=None)
    within = F.max(value).over(Window.partitionBy("__range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.get(F.array(*[F.lit(x).cast("string") for x in before]), F.col("__range"))
    return ranged.withColumn("greatest", F.greatest(within, earlier)).drop("__range", "place")


def sort_file(spark: SparkSession, path: str, out: str, keep_empty: bool = True) -> None:
    """Sorts the lines of path into the text files of the folder out, which must not exist; read in order of their names, they are sorted."""
    sort_lines(read_lines(spark, path), keep_empty).select("line").write.option("lineSep", "\n").text(out)
