"""What the training-data operators share: shared-folder tables, word splitting, Arrow plumbing and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictspark.functions.arrow import ALNUM, give_back, map_arrow
from dictspark.storage import discard, held, shared_folder, stored

__all__ = ["discard", "give_back", "held", "map_arrow", "shared_folder", "stored"]  # for the operators

#: Prefix of the columns that operators add for their own use; callers' columns don't start so.
OWN = "__ds_"

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))


def space_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; on bytes, both are what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and all characters from U+0080, after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


#: Up to so many keys (of about 100 bytes at most) are sent to the scan to find the rows that have them; for more, the rows are shuffled.
FEW = 1 << 18


def few_join(rows: DataFrame, keys: DataFrame, on: str | Column, how: str) -> DataFrame:
    """Semi, anti or left join of rows with a stored table of keys, without a shuffle of the rows if the keys are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, how)


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes, one row at least."""
    rows = max(1, -(-batch.num_rows * most // max(most, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, piece_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow of a function of a few rows at a time: a worker that made Python objects of a whole batch, and of what comes out of it,
    would hold several times its bytes, so batches are cut into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, piece_bytes):
                if (out := f(piece)) is not None and out.num_rows:
                    yield out

    return map_arrow(df, run, schema)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function of many whole groups at a time: f gets rows in which those with equal keys (integers) stand together, and the
    place where each group begins. For many small groups of a bounded size; a group lies in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.num_rows and (out := f(rows, starts)) is not None and out.num_rows:
                yield out

        for batch in batches:
            rows = pa.concat_batches([*held, batch])
            starts = np.flatnonzero(np.any([np.diff(k, prepend=k[:1] - 1) != 0 for k in (rows.column(rows.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in keys)], axis=0))
            if not len(starts):
                continue
            yield from done(rows.slice(0, int(starts[-1])), starts[:-1])
            held = [rows.slice(int(starts[-1]))]
        for rows in held:
            yield from done(rows, np.zeros(1, np.int64))

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the multiply and shift constants are splitmix64's fixed values)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)  # a fixed odd number
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A 64-bit value per byte, and the same after lower-casing A-Z.
EXACT = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_VALUES = EXACT.copy()
_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NO_ALNUM = np.frombuffer(ALNUM, np.uint8) == 0x20
#: Bytes that are hashed at a time, if a white space lies within them.
_STRETCH = 1 << 16


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _STRETCH + 1)
            with np.errstate(over="ignore"):
                cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def bytes_of(text: str | None) -> np.ndarray:
    """The text in UTF-8."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)


def words_at(data: np.ndarray, values: np.ndarray = _VALUES, gaps: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words (what lies between bytes that are gaps), in order. A hash is a polynomial over the
    values of the word's bytes, taken from running sums of a stretch of data, so that no word becomes a Python object."""
    begins, stops, out, at = [], [], [], 0
    while at < len(data):
        end = at + _STRETCH
        if end < len(data):
            cut = np.flatnonzero(gaps[data[at:end]])
            while not len(cut) and end < len(data):  # a longer word than the stretch
                end = min(len(data), at + 2 * (end - at))
                cut = np.flatnonzero(gaps[data[at:end]])
            end = at + int(cut[-1]) + 1 if len(cut) and end < len(data) else min(end, len(data))
        part = data[at:end]
        black = np.concatenate([[False], ~gaps[part], [False]])
        turns = np.flatnonzero(black[1:] != black[:-1])
        starts, ends = turns[::2], turns[1::2]
        up, down = _Powers.to(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(values[part] * up[: len(part)], dtype=np.uint64)])
            out.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        begins.append(starts + at)
        stops.append(ends + at)
        at = end
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(begins), np.concatenate(stops), np.concatenate(out)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words that space_words gives, in order."""
    return words_at(bytes_of(text))[2]


def alnum_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words that alnum_words gives, in order."""
    return words_at(bytes_of(text), _VALUES, _NO_ALNUM)[2]


#: Edges for each file of components' tables, at least.
FILE_EDGES = 1 << 14


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of the undirected edges (a long, b long): one row (node, label) for each node of an edge, label being
    the smallest node of its component. A stored table, as discard() takes it.

    Each node hooks onto its smallest neighbour, the pointers are doubled until they rest at roots, and the edges between different
    roots go into the next round. A round is joins and aggregations with partial sums only; the number of rounds is logarithmic.
    """
    left = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), f"{name}-edges", None, FILE_EDGES)
    files = max(1, left.count() // FILE_EDGES)
    labels: DataFrame | None = None
    while labels is None or not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        tree = stored(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("label")), f"{name}-hook", files)
        moved = True
        while moved:  # two doublings for each table that is written
            root = lambda t, of, to: t.select(F.col("node").alias(of), F.col("label").alias(to))
            once = tree.join(root(tree, "label", "up"), "label").select("node", "label", "up")
            twice = once.join(root(tree, "up", "top"), "up").join(root(tree, "top", "root"), "top")
            before, tree = tree, stored(twice.select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved")), f"{name}-jump", files)
            discard(before)
            moved = not tree.where("moved").isEmpty()
        ends = left.join(tree.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(tree.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        rest = stored(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{name}-edges", files)
        if labels is None:
            labels = tree
        else:
            step = tree.select(F.col("node").alias("label"), F.col("label").alias("root"))
            before, labels = labels, stored(labels.join(step, "label", "left").select("node", F.coalesce("root", "label").alias("label")), f"{name}-labels", files)
            discard(before, tree)
        discard(left)
        left = rest
    discard(left)
    out = labels.select("node", "label")
    out._stored_at = labels._stored_at
    return out
