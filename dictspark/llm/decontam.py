"""Benchmark decontamination with a distributed positional inverted index.

The index of the training documents is a stored table, partitioned by document: a row is a segment (about SEGMENT bytes of documents,
one at least) with the posting lists of its terms: for each term, all its positions in the segment's documents, laid end to end with gaps
between them. Terms are 64-bit hashes of the words.

The test items' windows are searched in it. The index gives each term's count over all documents; a window is searched from its rarest
term: that term's posting list, shifted by its offset in the window, is intersected with the shifted lists of the other terms, rarest
first. What is left are exact phrase matches. With a slop, the same lists give proximity matches: all terms of the window in reach of
their places. In a segment, all windows are searched at once, and only those whose rarest term it holds cost anything. A window with a
term that no document holds is never searched.

As a document lies in one segment, nothing is shuffled but what was found. The items go to the segments in blocks of a bounded size, a
pass over the stored index for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictspark.llm.common import OWN, alnum_hashes, few_join, map_arrow, map_batches, pieces, stored

#: Bytes of documents in a segment.
SEGMENT = 1 << 20
#: Positions without a term before each document; a window and twice the slop must be less.
GAP = 256
#: Items, and bytes of their texts, that are searched in one pass.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 4 << 20
#: Terms of the items that the index may be limited to; with more, it holds all terms of the documents.
MOST_TERMS = 1 << 22
#: Documents with a match for each file of their table, at least.
FILE_FOUND = 1 << 12
#: Places that are held against the lists at a time.
_STRIP = 1 << 19

_INDEX = "segment long, ids array<long>, h array<long>, words array<int>, terms binary, counts binary, positions binary"


def _segment(number: int, batch: pa.RecordBatch, terms: np.ndarray | None) -> list:
    """A row of the index for the batch's documents (id, hash of the text, text). Positions are stored as differences."""
    hashes = [alnum_hashes(t) for t in batch.column(2).to_pylist()]
    words = np.array([len(h) for h in hashes], np.int64)
    every = np.concatenate(hashes)
    at = np.arange(len(every)) + GAP * np.repeat(np.arange(1, len(words) + 1), words)
    if terms is not None:
        held = _member(every, terms)
        every, at = every[held], at[held]
    order = np.argsort(every, kind="stable")
    every, at = every[order], at[order]
    first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
    counts = np.diff(np.append(first, len(every))).astype(np.int32)
    return [number, batch.column(0).to_pylist(), batch.column(1).to_pylist(), words.tolist(), every[first].tobytes(), counts.tobytes(), np.diff(at, prepend=0).astype(np.int32).tobytes()]


def _member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of docs (a table of segments). terms: sorted hashes of the only terms to be held; None: all. Null and empty texts have
    no words and stand in the index with none."""
    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)), F.col(text_col))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split(" ")[0] for x in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, task = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, SEGMENT):
                row = _segment(task + n, piece, terms)
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return stored(map_arrow(rows, run, _INDEX), "index")


class Windows:
    """The windows of a block of items: rows of term numbers (-1 beyond the end of a short item's only window), the items of each window and
    the order in which a window's terms are looked up."""

    def __init__(self, rows: list[tuple[str, str | None]], size: int):
        hashes = [alnum_hashes(t) for _, t in rows]
        self.terms = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
        self.ids = sorted({i for i, _ in rows})
        number, made, owner = {x: k for k, x in enumerate(self.ids)}, [np.empty((0, size), np.int32)], []
        for (i, _), h in zip(rows, hashes, strict=True):
            if len(h):
                own = np.searchsorted(self.terms, h).astype(np.int32)
                own = np.lib.stride_tricks.sliding_window_view(own, size) if len(h) >= size else np.pad(own, (0, size - len(h)), constant_values=-1)[None, :]
                made.append(own)
                owner.append(np.full(len(own), number[i]))
        every, place = np.unique(np.concatenate(made), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([place.ravel(), np.concatenate([np.empty(0, np.int64), *owner])], 1), axis=0)
        self.rows, self.items = every, pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(every) + 1))
        self.order = np.zeros(every.shape, np.uint8)

    def rank(self, counts: np.ndarray) -> None:
        """counts: of each term over all documents. Windows with a term that is in none go; the others are looked up from their rarest term."""
        able = np.flatnonzero((np.where(self.rows >= 0, np.append(counts, 0)[self.rows], 1) > 0).all(1)) if len(self.rows) else np.empty(0, np.int64)
        n = np.diff(self.first)[able]
        self.items = self.items[np.repeat(self.first[able] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.rows, self.first = self.rows[able], np.concatenate([[0], np.cumsum(n)])
        weight = np.where(self.rows >= 0, np.append(counts, 0)[self.rows], np.iinfo(np.int64).max)
        self.order = np.argsort(weight, axis=1, kind="stable").astype(np.uint8)

    def lengths(self) -> np.ndarray:
        return (self.rows >= 0).sum(1)


class Lists:
    """The posting lists of a segment for the terms of some windows: term * span + position, ascending."""

    def __init__(self, windows: Windows, terms: bytes, counts: bytes, positions: bytes, span: int):
        own, n, at = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64), np.cumsum(np.frombuffer(positions, np.int32), dtype=np.int64)
        number = np.searchsorted(windows.terms, own)
        held = _member(own, windows.terms)
        self.span, self.n, self.begin = span, np.zeros(len(windows.terms) + 1, np.int64), np.zeros(len(windows.terms) + 1, np.int64)
        self.n[number[held]] = n[held]
        self.begin[number[held]] = np.cumsum(n[held]) - n[held]
        self.flat = at[np.repeat(held, n)] + np.repeat(number[held], n[held]) * span

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term's list has a position from low to high."""
        if not len(self.flat):
            return np.zeros(len(term), bool)
        at = np.searchsorted(self.flat, term * self.span + low)
        return (at < len(self.flat)) & (self.flat[np.minimum(at, len(self.flat) - 1)] <= term * self.span + high)

    def search(self, windows: Windows, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, starts, positions of the rarest terms) at which each term of the window lies within slop positions of its place; a
        window's starts come for each of its rarest term's positions."""
        rare = windows.order[:, 0].astype(np.int64)
        term = windows.rows[np.arange(len(rare)), rare]
        n = self.n[term] * (2 * slop + 1)
        able = np.flatnonzero(n)
        cuts = np.searchsorted(np.cumsum(n[able]), np.arange(_STRIP, n.sum() + _STRIP, _STRIP), "left") + 1 if len(able) else []
        for part in np.split(able, np.unique(cuts)):
            if not len(part):
                continue
            own = self.n[term[part]]
            w = np.repeat(part, own)
            place = self.flat[np.repeat(self.begin[term[part]] - np.cumsum(own) + own, own) + np.arange(own.sum())] - term[w] * self.span
            w, place = np.repeat(w, 2 * slop + 1), np.repeat(place, 2 * slop + 1)
            start = place - rare[w] + np.tile(np.arange(-slop, slop + 1), len(w) // (2 * slop + 1))
            for j in range(1, windows.rows.shape[1]):
                k = windows.order[w, j].astype(np.int64)
                t = windows.rows[w, k].astype(np.int64)
                keep = (t < 0) | self.within(t, start + k - slop, start + k + slop)
                w, start, place = w[keep], start[keep], place[keep]
                if not len(w):
                    break
            else:
                yield w, start, place


def _found(row: dict, windows: Windows, slop: int) -> list[tuple]:
    """(segment, place of the document, hit word positions, items, items in proximity) of the segment's documents with a match."""
    words = np.array(row["words"], np.int64)
    starts = np.cumsum(words + GAP) - words
    lists = Lists(windows, row["terms"], row["counts"], row["positions"], int(words.sum()) + GAP * (len(words) + 1))
    if not len(lists.flat):
        return []
    lengths, edge = windows.lengths(), np.zeros(lists.span + 1, np.int32)
    owners: list[dict[int, set[int]]] = [{}, {}]
    for kind, reach in enumerate((0, slop)[: 1 + bool(slop)]):
        for w, start, place in lists.search(windows, reach):
            doc = np.searchsorted(starts, place, "right") - 1
            if not kind:
                np.add.at(edge, start, 1)
                np.add.at(edge, start + lengths[w], -1)
            both = np.unique(np.stack([doc, w], 1), axis=0)
            for d, x in both.tolist():
                owners[kind].setdefault(d, set()).update(windows.items[windows.first[x] : windows.first[x + 1]].tolist())
    hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    of = np.searchsorted(starts, hit, "right") - 1
    named = lambda x: sorted(windows.ids[i] for i in x)
    return [(row["segment"], d, (hit[of == d] - starts[d]).tolist(), named(owners[0].get(d, ())), named(owners[1].get(d, ()))) for d in sorted({*owners[0], *owners[1]})]


def _blocks(items: DataFrame, item_id: str, item_text: str, block_items: int, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks, dealt by a hash; repeated rows once. A block of about block_items rows and block_bytes bytes reaches the driver."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    for b in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()]


def _terms(items: DataFrame, item_text: str) -> np.ndarray | None:
    """The sorted hashes of the items' terms, None if they are more than MOST_TERMS."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.unique(np.concatenate([np.empty(0, np.uint64), *(alnum_hashes(t) for t in batch.column(0).to_pylist())]))
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["term"])

    found = map_batches(items.select(item_text), run, "term long").distinct().limit(MOST_TERMS + 1).toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64)) if found.num_rows <= MOST_TERMS else None


def counts(index_: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the terms (sorted hashes) stands in the documents: sums over the segments, of which only two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, n = np.frombuffer(own, np.uint64), np.frombuffer(n, np.int32)
                held = _member(own, terms)
                sums[np.searchsorted(terms, own[held])] += n[held]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for term, n in map_arrow(index_.select("terms", "counts"), run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each of the block's terms at most
        out[term] = n
    return out


def matches(index_: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 8, slop: int = 0, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """segment, place, hits (word positions within exact matches of a window, ascending), items (their ids, sorted as strings) and near (ids of
    items with a proximity match, if there is a slop) of the documents that hold any.

    A window is `window` consecutive words of an item; an item of fewer words is one window, an item without words has none. Items of the
    same id count as one item; a null id reads as the text 'null'. The items are the stated test set."""
    if window + 2 * slop >= GAP:
        raise ValueError(f"a window and twice the slop must be less than {GAP} words")
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
    names, out = ["segment", "place", "hits", "items", "near"], None
    schema = "segment long, place int, hits array<int>, items array<string>, near array<string>"
    for rows in _blocks(items, item_id, item_text, block_items, block_bytes):
        windows = Windows(rows, window)
        windows.rank(counts(index_, windows.terms))

        def run(batches: Iterator[pa.RecordBatch], windows: Windows = windows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    if found := _found(batch.slice(i, 1).to_pylist()[0], windows, slop):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        part = map_arrow(index_.select("segment", "words", "terms", "counts", "positions"), run, schema)
        out = part if out is None else out.union(part)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  a row of each block at most
    return out.groupBy("segment", "place").agg(*(joined(c) for c in names[2:]))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, slop: int = 0, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document: id, h (xxhash64 of the text), n_words, hits, items and near as matches() gives them, null where nothing was found."""
    own = index(docs, _terms(items, item_text), id_col, text_col)
    every = own.select("segment", F.posexplode(F.arrays_zip("ids", "h", "words")).alias("place", "d")).select("segment", "place", F.col("d.ids").alias("id"), F.col("d.h").alias("h"), F.col("d.words").cast("long").alias("n_words"))
    found = stored(matches(own, items, item_id, item_text, window, slop, block_items), "matches", rows_a_file=FILE_FOUND)
    return every.join(found, ["segment", "place"], "left").select("id", "h", "n_words", "hits", "items", "near")


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, slop: int = 2, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity match).

    Null and empty texts have no words; repeated rows get a row each; rows may lack an id; empty tables give no rows or no matches;
    further columns of any name are not read."""
    rows = search(docs, items, id_col, text_col, window=window, slop=slop, block_items=block_items)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    n = size("items")
    own = F.coalesce(F.array_join("items", ","), F.lit(""))
    return rows.select(F.col("id").alias("doc_id"), "n_words", size("hits").alias("n_hit"), n.alias("n_items"), F.sha2(own, 256).alias("items_sha256"), (n >= min_items).alias("contaminated"), *([size("near").alias("n_near")] if slop else []))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which fewer than min_items items have an exact match, with their own columns."""
    found = search(docs, items, id_col, text_col, window=window).where(F.size("items") >= min_items)
    gone = stored(found.select(F.col("id").alias(f"{OWN}id"), F.col("h").alias(f"{OWN}h")).distinct(), "contaminated", rows_a_file=FILE_FOUND)
    return few_join(docs, gone, F.col(id_col).cast("long").eqNullSafe(F.col(f"{OWN}id")) & (F.xxhash64(F.col(text_col)) == F.col(f"{OWN}h")), "left_anti")
