"""Functions of Arrow batches in Python workers."""

from __future__ import annotations

import ctypes
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a worker. (Spark's own limit is 64 MB, of which a worker holds several at a time; an executor keeps the
#: memory of some batches for each thread that once wrote them.)
BATCH = 1 << 20
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
ALNUM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Distinct words that a worker counts before it passes them on (about 150 bytes each).
COUNTED = 1 << 18
#: Bytes of a text that are cut into words at a time, up to the next end of a word.
STRETCH = 1 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find the package


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of at most BATCH bytes (one row at least), a setting of the session that is lowered where it is higher."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(BATCH)).rstrip("bB")) > BATCH:
        conf.set(name, f"{BATCH}b")

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(released, schema)


def give_back() -> None:
    """Gives the memory that a worker has freed back to the system. A worker outlives its task, and the allocators would keep what was the
    most it took, beside all that later tasks of other operators take."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def _rows(counts: Counter) -> pa.RecordBatch:
    keys = pa.array(counts, pa.binary())
    try:
        words = keys.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8, read as Spark reads them
        words = pa.array([w.decode(errors="replace") for w in counts], pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["key", "n"])


def word_counts(texts: DataFrame, text_col: str = "text", most: int = COUNTED) -> DataFrame:
    """key, n: the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the texts after lower-casing A-Z, each with its occurrences in a part of the
    texts. A word has a row for each part, to be added up; no occurrence becomes a row by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text, at = text.translate(ALNUM), 0
                while at >= 0:
                    end = text.find(b" ", at + STRETCH)
                    counts.update((text[at:end] if end >= 0 else text[at:]).split())
                    at = end
                    if len(counts) >= most:
                        yield _rows(counts)
                        counts.clear()
        if counts:
            yield _rows(counts)

    return map_arrow(texts.select(F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL"), run, "key string, n long")
