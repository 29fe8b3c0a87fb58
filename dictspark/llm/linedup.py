"""Line deduplication with a fixed-depth log-template tree.

A line's tokens are its words. Tokens with a digit are variable fields (`<*>`) if the constant tokens that remain make up SIMILARITY of
the line; otherwise (tables, lists of numbers) the line keeps its tokens as they are. The tree's first level is the number of tokens, the
next DEPTH levels are the leading tokens; a leaf holds the lines that agree in these.

Below the leaf, variable fields without digits are found by masks: the tokens after the leading ones are cut into BANDS runs of like
length (at most one run per token), and a mask hides one or two of them. A masked line is a template if what it shows has constant tokens
for SIMILARITY of the line. Lines that differ only in what some mask hides share that template, whatever else is in the leaf, so what
recurs does not depend on the size of the corpus. Up to two variable fields are found anywhere, longer ones if two runs hold them.

A template, masked or not, that recurs across documents is dropped everywhere but in the document with the smallest id that holds it.
Short lines recur by chance: below SHORT tokens a template must be in MANY documents. Everything is counted over all documents by
aggregations with partial sums (a hot line is summed up before it is shuffled), and no leaf is ever gathered in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictspark.llm.common import EXACT, OWN, bytes_of, discard, few_join, held, map_batches, mixed, stored, words_at

DEPTH = 3
#: Share of a line's tokens that must be constant in a template, as a fraction.
SIMILARITY = 7, 10
SHORT, MANY = 8, 10
BANDS = 8
#: Bands that a mask hides: one or two.
MASKS = [(a, b) for a in range(BANDS) for b in range(a, BANDS)]
#: Of three groups of bands, a mask of two leaves one whole.
_GROUPS = (0, 1, 2), (3, 4, 5), (6, 7)
#: Documents that lose lines for each file of their table, at least.
FILE_DOCS = 1 << 14

_NUMBER = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_ODD = np.uint64(0x9E3779B97F4A7C15)  # a fixed odd number
_STAR = words_at(np.frombuffer(b"<*>", np.uint8), EXACT)[2][0]


def lines_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def _lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row per line with a word: document, hash of its text, place, template (128 bits), leaf, number of tokens, the bands' hashes and
    which masks the line may have (a bit each). All texts of the batch are worked on at once, laid end to end."""
    parts = [bytes_of(t) for t in batch.column(2).to_pylist()]
    end = np.array([10], np.uint8)
    data = np.concatenate([x for p in parts for x in (p, end)])
    origin = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
    breaks = np.flatnonzero(data == 10)
    starts, _, h = words_at(data, EXACT)
    line = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.diff(line, prepend=-1))  # each line's first token
    n = np.diff(np.append(first, len(line)))
    own = np.repeat(np.arange(len(first)), n)
    i, size = np.arange(len(line)) - first[own], n[own]
    number = np.zeros(len(line), bool)
    number[np.searchsorted(starts, np.flatnonzero(_NUMBER[data]), "right") - 1] = True
    if not len(first):
        return _rows(batch.slice(0, 0), *[np.empty(0, np.int64)] * 6, np.empty((0, BANDS), np.uint64), np.empty(0, np.int64))
    enough = lambda constant: SIMILARITY[1] * constant >= SIMILARITY[0] * n
    general = enough(n - np.add.reduceat(number, first, dtype=np.int64))
    with np.errstate(over="ignore"):
        token = np.where(number & general[own], _STAR, h)
        place = mixed(token + (i.astype(np.uint64) + np.uint64(1)) * _ODD)
        k1 = np.bitwise_xor.reduceat(place, first)
        k2 = np.add.reduceat(mixed(place ^ _ODD), first, dtype=np.uint64)
        leaf = mixed(np.bitwise_xor.reduceat(np.where(i < DEPTH, place, np.uint64(0)), first) + n.astype(np.uint64) * _ODD)
    constant = token != _STAR
    bands, fixed = np.zeros((len(first), BANDS), np.uint64), np.zeros((len(first), BANDS), np.int64)
    rest = np.flatnonzero(i >= DEPTH)
    if len(rest):
        j, m = i[rest] - DEPTH, size[rest] - DEPTH
        cell = own[rest] * BANDS + np.where(m >= BANDS, j * BANDS // m, j)
        turn = np.flatnonzero(np.diff(cell, prepend=-1))
        bands.ravel()[cell[turn]] = np.bitwise_xor.reduceat(place[rest], turn)
        fixed.ravel()[cell[turn]] = np.add.reduceat(constant[rest], turn, dtype=np.int64)
    every, allowed = np.add.reduceat(constant, first, dtype=np.int64), np.zeros(len(first), np.int64)
    for k, (a, b) in enumerate(MASKS):
        shown = every - fixed[:, a] - (fixed[:, b] if a != b else 0)
        allowed |= (enough(shown) & (n - DEPTH > b)).astype(np.int64) << k
    at = line[first]
    before = np.searchsorted(breaks, origin)  # lines before each document
    row = np.searchsorted(before, at, "right") - 1
    return _rows(batch.select([0, 1]).take(pa.array(row)), at - before[row], k1, k2, leaf, n, row, bands, allowed)


def _rows(docs: pa.RecordBatch, at, k1, k2, leaf, n, _row, bands, allowed) -> pa.RecordBatch:
    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    cols = [docs.column(0), docs.column(1), pa.array(at.astype(np.int32)), long(k1), long(k2), long(leaf), pa.array(n.astype(np.int32)), *(long(bands[:, b]) for b in range(BANDS)), pa.array(allowed)]
    return pa.RecordBatch.from_arrays(cols, names=["doc", "h", "at", "k1", "k2", "leaf", "n", *(f"x{b}" for b in range(BANDS)), "allowed"])


_LINES = "doc long, h long, at int, k1 long, k2 long, leaf long, n int, " + ", ".join(f"x{b} long" for b in range(BANDS)) + ", allowed long"


def _keys(docs: DataFrame, id_col: str, text_col: str) -> dict:
    """The document's key: its id and a hash of its text. Without an id, a large number from the text stands for it."""
    h = F.xxhash64(F.col(text_col))
    return {f"{OWN}doc": F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(h, 2).bitwiseOR(F.lit(1 << 62))), f"{OWN}h": h}


def _xor(*columns: str) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), [F.col(c) for c in columns])


def _firsts(lines: DataFrame, min_docs: int) -> DataFrame:
    """k1, k2, first: the templates that recur and the document that keeps them. Held, as all tables in it: lines, from which they are made, stays meanwhile."""
    keys, bands = ["k1", "k2"], [f"x{b}" for b in range(BANDS)]
    groups = [_xor(*(f"x{b}" for b in g)).alias(f"g{i}") for i, g in enumerate(_GROUPS)]
    slim = lines.select(*keys, "doc", "leaf", "n", (F.col("allowed") != 0).cast("int").alias("able"), *groups)
    own = [F.max(c).alias(c) for c in ("leaf", "n", "able", "g0", "g1", "g2")]
    each = slim.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), *own)
    # Only short lines need the number of their documents; of others, two are enough.
    short = lines.where(f"n < {SHORT}") if min_docs <= 2 else lines
    docs = short.select(*keys, "doc").distinct().groupBy(*keys).agg(F.count("*").alias("docs"))
    each = held(each.join(docs, keys, "left").withColumn("docs", F.coalesce("docs", F.lit(1) + (F.col("first") < F.col("last")).cast("long"))))
    enough = (F.col("first") < F.col("last")) & (F.col("docs") >= F.when(F.col("n") < SHORT, F.lit(max(MANY, min_docs))).otherwise(F.lit(min_docs)))
    plain = each.where(enough).select(*keys, "first")
    # Lines that share a leaf, and in it one of three groups of bands, with a line of another document.
    spread = [F.min("first").alias("x"), F.max("last").alias("y"), F.count("*").alias("lines")]
    leaves = each.where("able = 1").groupBy("leaf").agg(*spread).where("lines > 1 AND x < y").select("leaf")
    able = each.where("able = 1").join(leaves, "leaf").select(*keys, "leaf", "first", "last", F.posexplode(F.array("g0", "g1", "g2")).alias("g", "part"))
    grouped = able.groupBy("leaf", "g", "part").agg(*spread).where("lines > 1 AND x < y").select("leaf", "g", "part")
    near = held(able.join(grouped, ["leaf", "g", "part"], "left_semi").select(*keys).distinct())
    banded = few_join(lines.select(*keys, "allowed", *bands), near, keys, "left_semi").groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("allowed", *bands)))
    shown = F.array(*[F.when(F.shiftright("allowed", k).bitwiseAND(1) == 1, F.struct(F.lit(k).alias("mask"), _xor("k1", *dict.fromkeys((f"x{a}", f"x{b}"))).alias("shown"))) for k, (a, b) in enumerate(MASKS)])
    masked = banded.select(*keys, F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("m")).join(each.select(*keys, "leaf", "n", "first", "last", "docs"), keys)
    masked = held(masked.select(*keys, "leaf", "n", "first", "last", "docs", "m.mask", "m.shown"))
    key = ["leaf", "n", "mask", "shown"]
    recurring = masked.groupBy(*key).agg(F.count("*").alias("lines"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("docs").alias("docs")).where("lines > 1").where(enough)
    wide = masked.drop("first", "last", "docs").join(recurring.select(*key, "first"), key).select(*keys, "first")
    out = held(plain.union(wide).groupBy(*keys).agg(F.min("first").alias("first")))
    discard(each, near, masked)
    return out


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2) -> DataFrame:
    """docs with recurring lines dropped from the text, and two columns more: __ds_lines (lines of the text) and __ds_dropped.

    Null and empty texts stay as they are (0 lines). A line without a word is never dropped. Lines end at U+000A; what is kept is kept to
    the byte. Rows with the same id are one document: a line that only they hold does not recur, whether their texts are the same
    (repeated rows) or not. A row without an id is a document of its own text, after all those with one. All other columns pass
    through; none may begin with __ds_. An empty table gives no rows. Tokens are compared by 64-bit hashes, lines by 128 bits.
    """
    keyed = docs.withColumns(_keys(docs, id_col, text_col))
    lines = stored(map_batches(keyed.select(f"{OWN}doc", f"{OWN}h", text_col), _lines, _LINES), "line-rows")
    first = _firsts(lines, min_docs)
    gone = lines.select("k1", "k2", "doc", "h", "at").join(first, ["k1", "k2"]).where("doc <> first").groupBy(F.col("doc").alias(f"{OWN}doc"), F.col("h").alias(f"{OWN}h")).agg(F.collect_set("at").alias(f"{OWN}gone"))
    gone = stored(gone, "line-gone", rows_a_file=FILE_DOCS)
    discard(lines, first)
    rows = keyed.join(gone, [f"{OWN}doc", f"{OWN}h"], "left").select(*docs.columns, f"{OWN}gone")
    at, last = docs.columns.index(text_col), len(docs.columns)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, dropped = [], [], []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
            own = text.split("\n") if text else []
            out = set(gone or ())
            counts.append(len(own))
            dropped.append(len(out))
            texts.append("\n".join(x for i, x in enumerate(own) if i not in out) if out else text)
        cols = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
        return pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*batch.schema.names[:-1], f"{OWN}lines", f"{OWN}dropped"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(rows, cut, f"{kept}, {OWN}lines long, {OWN}dropped long")


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with their own columns and cleaned texts; a document that loses lines and is left without a word goes. chars_col, if there
    is one, is the text's length and follows it."""
    out = drop_recurring_lines(docs, id_col, text_col)
    out = out.where((F.col(f"{OWN}dropped") == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.when(F.col(f"{OWN}dropped") > 0, F.length(text_col)).otherwise(F.col(c)).cast(t).alias(c) if c == chars_col else F.col(c) for c, t in docs.dtypes])
