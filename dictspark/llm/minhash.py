"""Near-duplicates with HyperMinHash sketches.

A document's set is its distinct 5-word shingles. The sketch has REGISTERS buckets; a shingle's hash chooses a bucket, and the bucket keeps
its smallest hash in compressed form: the number of leading zeros and the mantissa bits after the first one (6 + 10 bits). Buckets that
no shingle chose borrow from one that is chosen by a fixed probe order, so small sets have full sketches too. Groups of ROWS registers
form bands; documents with an equal band meet in a bucket. Candidates are weighed by the estimate of their Jaccard similarity,
corrected for registers that agree by chance, and what remains is confirmed on the full sets (of 64-bit hashes of the shingles).

Documents with the same set are one class from the start (copies are never expanded). In a bucket, every class is held against the
smallest class. Components are formed from the confirmed links; then only buckets that still hold different components are searched
in full, in blocks, for links between those components. So every two classes that share a band and are not yet connected are held
against each other (in their first common band only), and a block gives links, not pairs: at most one per class. The classes of buckets
of over HOT classes, where that search would be quadratic, are dealt anew by the rarest shingles of their full sets, so many that two sets
that are linked have one of them in common. That is exact: the links found do not depend on HOT.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictspark.llm.common import components, discard, few_join, map_batches, map_groups, mixed, stored, word_hashes

REGISTERS = 128
#: 25 bands of 5 registers: two sets at similarity 0.85 miss each other in all bands with a chance of 4e-7, at 0.9 of 1e-10.
BANDS, ROWS = 25, 5
#: For links from 0.8 on: all registers, in 32 bands of 4. Two sets at 0.8 miss each other with a chance of 5e-8 (25 bands of 5: 5e-5).
WIDE = 32, 4
MANTISSA = 10
#: Five standard errors of the estimate (sqrt(s (1 - s) / REGISTERS)) below the threshold: less is no candidate.
_ERRORS = 5
#: Classes of a bucket that are held against as many others at a time, and shingles of these.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Documents for each file of a table in between, at least: every file costs its writer a process (chmod) with Hadoop's local file system.
FILE_ROWS = 4096
#: Documents (id, hash and two marks) for each file of the table of those that stay, at least.
FILE_PLACES = 1 << 16
#: The classes of larger buckets are dealt anew by their rarest shingles. FREQUENT is the most shingles whose counts go to the driver.
HOT, FREQUENT = 2048, 1 << 17

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # a fixed odd number: the order of words in a shingle matters


def _probes() -> np.ndarray:
    """The order in which a bucket asks others: row t has the t-th choice of each bucket."""
    t, j = np.meshgrid(np.arange(64, dtype=np.uint64), np.arange(REGISTERS, dtype=np.uint64), indexing="ij")
    return (mixed(t * np.uint64(REGISTERS) + j + np.uint64(1)) % np.uint64(REGISTERS)).astype(np.int64)


_PROBES = _probes()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * _MULTIPLIER + h[k : len(h) - n + 1 + k]
        return np.unique(mixed(out + np.uint64(n)))


def sketch(h: np.ndarray) -> np.ndarray:
    """REGISTERS compressed minima: leading zeros << MANTISSA | the bits after the first one."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    g = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
    np.minimum.at(low, (g % np.uint64(REGISTERS)).astype(np.int64), g >> np.uint64(7))
    full = low != np.iinfo(np.uint64).max
    value = np.where(full, low, 0).astype(np.uint64)
    bits = np.frexp((value >> np.uint64(4)).astype(np.float64))[1].astype(np.int64) + 4  # length in bits, of 57; the upper 53 are exact
    shift = np.maximum(bits - MANTISSA, 0).astype(np.uint64)
    mantissa = (value >> shift) & np.uint64((1 << MANTISSA) - 1)
    reg = (((57 - bits) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)
    if not full.all():
        held = full[_PROBES]
        found, first = held.any(0), held.argmax(0)
        nearest = np.flatnonzero(full)
        source = np.where(found, _PROBES[first, np.arange(REGISTERS)], nearest[np.searchsorted(nearest, np.arange(REGISTERS)) % len(nearest)])
        reg = np.where(full, reg, reg[source])
    return reg


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from sketches (one row each), corrected for collisions. Two unlike registers agree if their leading zeros do
    (chance 1/3 for hashes of geometric length, summed over 2^-2k) and their mantissas do (2^-MANTISSA)."""
    return estimate_of(a == b)


def estimate_of(same: np.ndarray) -> np.ndarray:
    chance = 2.0**-MANTISSA / 3
    return np.maximum((np.mean(same, axis=-1) - chance) / (1 - chance), 0)


def _least(num: int, den: int) -> float:
    s = num / den
    return s - _ERRORS * (s * (1 - s) / REGISTERS) ** 0.5


def _sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, sizes, regs = [], [], []
    for text in batch.column(1).to_pylist():
        h = shingles(text)
        sizes.append(len(h))
        keys.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
        regs.append(sketch(h).tobytes() if len(h) else None)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "h", "key", "n", "regs"])


def _near(batch: pa.RecordBatch, least: float) -> pa.RecordBatch:
    """Pairs whose estimate reaches least: columns a, b, ra, rb."""
    a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
    return batch.filter(pa.array(estimate(a, b) >= least)).select(["a", "b"])


#: Instead of a band's number: the shingle is among those that a set of its size shares with a linked set of as many or more; or only with
#: a smaller one.
EARLY, LATE = -1, -2


def _rarest(h: np.ndarray, order: tuple[np.ndarray, np.ndarray], num: int, den: int) -> tuple[np.ndarray, int]:
    """The first shingles of a set, the rare ones ahead, and how many of them are EARLY. Sets of n and m >= n shingles that are linked have at
    least num (n + m) / (num + den) in common, so the first of these in any one order of all shingles is among the first
    n - 2 num n / (num + den) + 1 of the one and, as n >= num m / den, the first m - num m / den + 1 of the other. order: the frequent shingles,
    sorted, and their ranks by count; all others come before them."""
    frequent, ranks = order
    n, rank = len(h), np.zeros(len(h), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        rank = np.where(frequent[at] == h, ranks[at], 0)
    return h[np.lexsort((h, rank))[: n + 1 - -(-num * n // den)]], n + 1 - -(-2 * num * n // (num + den))


def _holds(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, for sorted sets."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(x) + len(y) - common)


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _binaries(rows: pa.RecordBatch, name: str) -> list[bytes]:
    return rows.column(rows.schema.get_field_index(name)).to_pylist()


def _on_star(rows: pa.RecordBatch, starts: np.ndarray, num: int, den: int) -> pa.RecordBatch:
    """Of groups of pairs with one b, the pairs that hold on the full sets; the row with the set of b has no a. Columns b, part, a, set."""
    has = rows.column(2).is_valid().to_numpy(zero_copy_only=False)
    sets, keep = [np.frombuffer(x, np.uint64) for x in rows.column(3).to_pylist()], np.zeros(rows.num_rows, bool)
    for at, end in zip(starts, [*starts[1:], rows.num_rows], strict=True):
        centre = at + int(np.flatnonzero(~has[at:end])[0])
        for i in range(at, end):
            keep[i] = has[i] and _holds(sets[i], sets[centre], num, den)
    return rows.filter(pa.array(keep)).select(["a", "b"])


def _candidates(rows: pa.RecordBatch, starts: np.ndarray, least: float, bands: tuple[int, int]):
    """(i, places of its candidates) within each block of a bucket: rows x with rows y of the other chunk (or later rows of the same one), in
    different components, of which neither is the bucket's smallest class (those are held against all others before), near by estimate,
    and sharing no earlier band, in whose bucket they meet too. In buckets of a shingle (b is EARLY or LATE) two rows must share any band, and
    the shingle be early in the smaller set. rows: band, b, x, y, chunk, node, label, low, n, regs."""
    regs = np.frombuffer(b"".join(_binaries(rows, "regs")), np.uint16).reshape(-1, REGISTERS)
    node, label, chunk, low, size, b, x, y = (_numbers(rows, n) for n in ("node", "label", "chunk", "low", "n", "b", "x", "y"))
    able = node != low
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
        own = at + np.flatnonzero(able[at:end] & (chunk[at:end] == x[at]))
        others = at + np.flatnonzero(able[at:end] & (chunk[at:end] == y[at]))
        for i in own:
            other = others[(label[others] != label[i]) & ((node[others] > node[i]) | (x[at] != y[at]))]
            if b[i] == EARLY:
                other = other[(b[other] == EARLY) | (size[other] > size[i])]
            elif b[i] == LATE:
                other = other[(b[other] == EARLY) & (size[other] < size[i])]
            if len(other):
                same = regs[other] == regs[i]
                near = estimate_of(same) >= least
                if near.any():
                    shared = same[:, : bands[0] * bands[1]].reshape(-1, *bands).all(2)
                    near &= shared.argmax(1) == b[at] if b[at] >= 0 else shared.any(1)
                if len(other := other[near]):
                    yield int(i), other


_BLOCK = "band long, x int, y int, b int, chunk int, node long, label long, low long, n long, regs binary"


def _with_candidates(rows: pa.RecordBatch, starts: np.ndarray, least: float, bands: tuple[int, int]) -> pa.RecordBatch:
    """The rows of the blocks that have a candidate there."""
    held = np.zeros(rows.num_rows, bool)
    for i, other in _candidates(rows, starts, least, bands):
        held[i] = True
        held[other] = True
    return rows.filter(pa.array(held))


def _across(rows: pa.RecordBatch, starts: np.ndarray, least: float, num: int, den: int, bands: tuple[int, int]) -> pa.RecordBatch:
    """Links between components within the blocks, confirmed on the full sets; pairs that links found here connect already are passed over."""
    sets = [np.frombuffer(s, np.uint64) for s in _binaries(rows, "set")]
    node, label, a, b = _numbers(rows, "node").tolist(), _numbers(rows, "label").tolist(), [], []
    root = {x: x for x in label}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, other in _candidates(rows, starts, least, bands):
        for k in other.tolist():
            if (p := top(label[i])) != (q := top(label[k])) and _holds(sets[i], sets[k], num, den):
                root[max(p, q)] = min(p, q)
                a.append(max(node[i], node[k]))
                b.append(min(node[i], node[k]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, files: int) -> DataFrame:
    """node and its full set, for the given nodes; the text is that of the class's smallest document."""
    need = stored(classes.join(nodes.distinct(), "node", "left_semi").select("node", "key", F.col("first").alias("doc_id")), "near-need", files)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = [shingles(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(x.tobytes()).digest() for x in h], pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())], names=["doc_id", "key", "set"])

    texts = few_join(docs, need.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_semi")
    if not need.where("doc_id IS NULL").isEmpty():  # classes all of whose documents lack an id
        texts = texts.union(docs.where("doc_id IS NULL"))
    found = map_batches(texts, run, "doc_id long, key binary, set binary")
    match = found.join(need.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "node"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    out = stored(match.groupBy("node").agg(F.first("set").alias("set")), "near-sets", files)
    discard(need)
    return out


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """Of pairs (a, b), those that hold on the full sets. The pairs of one b are dealt into parts of a bounded size, each with the set of b."""
    sets = _sets(docs, classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), files)
    sized = pairs.join(classes.select(F.col("node").alias("a"), "n"), "a")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    dealt = pairs.join(sized.groupBy("b").agg(parts.alias("parts")), "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
    left = dealt.join(sets.select(F.col("node").alias("a"), "set"), "a").select("b", "part", "a", "set")
    centre = dealt.select("b", "part").distinct().join(sets.select(F.col("node").alias("b"), "set"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "set")
    links = stored(map_groups(left.union(centre), ["b", "part"], lambda x, at: _on_star(x, at, num, den), "a long, b long"), "near-links", files)
    discard(sets)
    return links


def _blocks(members: DataFrame, regs: DataFrame) -> DataFrame:
    """The blocks of the given buckets (band, b, node, label, low, size, shingles): each pair of a bucket's chunks, itself included."""
    chunks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(regs, "node").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.select("band", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "b", "chunk", "node", "label", "low", "n", "regs")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (at most FREQUENT) that stand in most sets, sorted, and their ranks by count, from 1."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], names=["shingle"])

    total = sets.agg(F.sum(F.length("set") / 8).cast("long")).first()[0]
    counts = map_batches(sets.select("set"), run, "shingle long").groupBy("shingle").count()
    found = counts.where(F.col("count") > max(1, -(-total // FREQUENT))).toArrow()
    shingle, count = found["shingle"].to_numpy().view(np.uint64), found["count"].to_numpy()
    ranks, order = np.empty(len(shingle), np.int64), np.argsort(shingle)
    ranks[np.lexsort((shingle, count))] = np.arange(1, len(shingle) + 1)
    return shingle[order], ranks[order]


def _dealt_anew(members: DataFrame, docs: DataFrame, classes: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """The classes of hot buckets in buckets of their rarest shingles. A stored table."""
    nodes = members.select("node", "label").distinct()
    sets = _sets(docs, classes, nodes.select("node"), files)
    order = _frequent(sets)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = [_rarest(np.frombuffer(s, np.uint64), order, num, den) for s in batch.column(1).to_pylist()]
        at = np.repeat(np.arange(batch.num_rows), [len(h) for h, _ in first])
        kind = np.concatenate([np.where(np.arange(len(h)) < early, EARLY, LATE) for h, early in first]).astype(np.int32)
        shingle = np.concatenate([h for h, _ in first]).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(shingle), pa.array(kind)], names=["node", "band", "b"])

    rarest = map_batches(sets.select("node", "set"), run, "node long, band long, b int").join(nodes, "node").join(classes.select("node", "n"), "node")
    rarest = stored(rarest, "near-rarest", files)
    sizes = rarest.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("label").alias("p"), F.max("label").alias("q"), F.max("b").alias("kind"))
    sizes = sizes.where("p <> q").where(F.col("kind") == EARLY).select("band", "size", "shingles")
    # Nothing is the smallest class of such a bucket, against which all are held before: no class is its own complement.
    out = stored(rarest.join(sizes, "band").select(F.xxhash64(F.lit("shingle"), "band").alias("band"), "b", "node", "label", F.bitwise_not("node").alias("low"), "size", "shingles"), "near-anew", files)
    discard(sets, rarest)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, bands: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Stored tables: rows (doc_id, h: a hash of the text, key: of the set, n, regs), and for each key its label (a node of the component) and
    component_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    least = _least(num, den)
    rows = map_batches(docs.withColumn("h", F.xxhash64("text")), _sketched, "doc_id long, h long, key binary, n long, regs binary")
    rows = stored(rows, "near-rows")
    files = max(1, rows.count() // FILE_ROWS)
    held = rows.where("key IS NOT NULL")
    classes = held.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = stored(classes.withColumn("node", F.coalesce("first", F.xxhash64("key").bitwiseOR(F.lit(-(1 << 63))))), "near-classes", files)
    width = 2 * bands[1]
    hashes = F.array(*[F.xxhash64(F.lit(b), F.substring("regs", b * width + 1, width)) for b in range(bands[0])])
    banded = classes.select("node", "n", F.posexplode(hashes).alias("b", "band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("low <> high").drop("high")
    buckets = stored(buckets, "near-buckets", files)
    members = stored(banded.drop("n").join(buckets, "band"), "near-members", files)
    discard(buckets)
    star = members.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    regs = classes.select("node", "n", "regs")
    side = star.join(regs.select(F.col("node").alias("a"), F.col("regs").alias("ra")), "a").join(regs.select(F.col("node").alias("b"), F.col("regs").alias("rb")), "b").select("a", "b", "ra", "rb")
    pairs = stored(map_batches(side, lambda x: _near(x, least), "a long, b long"), "near-pairs", files)
    links = _links(docs, classes, pairs, num, den, files)
    labels = components(links, "near-cc")
    # Buckets of three and more classes that are not yet one component: what else may be linked there?
    wide = members.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = wide.groupBy("band").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("band")
    split = stored(split, "near-split", files)
    open_ = stored(wide.join(split, "band", "left_semi").select("band", "b", "node", "label", "low", "size", "shingles"), "near-open", files)
    discard(members, pairs, split)
    blocks, anew = _blocks(open_.where(F.col("size") <= HOT), regs), []
    if not (hot := open_.where(F.col("size") > HOT)).isEmpty():
        anew = [_dealt_anew(hot, docs, classes, num, den, files)]
        blocks = blocks.union(_blocks(anew[0], regs))
    near = stored(map_groups(blocks, ["band", "x", "y"], lambda r, at: _with_candidates(r, at, least, bands), _BLOCK), "near-candidates", None, FILE_ROWS)
    discard(open_, *anew)
    if not near.isEmpty():
        sets = _sets(docs, classes, near.select("node"), files)
        more = stored(map_groups(near.join(sets, "node").select(*near.columns, "set"), ["band", "x", "y"], lambda r, at: _across(r, at, least, num, den, bands), "a long, b long"), "near-more")
        discard(sets)
        if not more.isEmpty():
            before, labels = labels, components(links.union(more), "near-cc")
            discard(before)
        discard(more)
    discard(links, near)
    linked = classes.join(labels, "node", "left").select("key", "first", F.coalesce("label", "node").alias("label"))
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    by_key = stored(linked.join(smallest, "label").select("key", "label", "component_id"), "near-labels", files)
    discard(classes, labels)
    return rows, by_key


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, bands: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Documents are linked if den * |A & B| >= num * |A | B|; component_id
    is the smallest id reachable over links.

    Empty and null texts have no shingles and are linked with nothing: each is its own component. Repeated rows (same id and text) get
    a row each. Rows that share an id but not a text count as one node where the id is the smallest of both their classes. Rows without
    an id take part in links; their component_id is the smallest id reachable, null if there is none, and they are kept only then.
    An empty table gives no rows; further columns of any name are not read.
    """
    rows, by_key = _grouped(docs, id_col, text_col, num, den, bands)
    result = lambda df, component: df.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    with_words = rows.where("key IS NOT NULL").select("doc_id", "n", "key").join(by_key.select("key", "component_id"), "key")
    return result(with_words, F.col("component_id")).union(result(rows.where("key IS NULL"), F.col("doc_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, bands: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """The documents with their own columns, one row of each component: that with the smallest id (rows without one come last) and then the
    smallest hash of the text. Documents without words are linked with nothing and all stay. bands: number of bands and registers in each."""
    rows, by_key = _grouped(docs, id_col, text_col, num, den, bands)
    held = rows.where("key IS NOT NULL").select("doc_id", "h", "key").join(by_key.select("key", "label"), "key")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    each = held.groupBy("label", "doc_id", "h").agg(F.count("*").alias("times"))
    best = each.groupBy("label").agg(F.min(place).alias("best"))
    marked = stored(each.join(best, "label").select(F.col("doc_id").alias("__ds_id"), F.col("h").alias("__ds_h"), (place == F.col("best")).alias("stays"), "times"), "near-places", None, FILE_PLACES)
    discard(rows, by_key)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__ds_id")) & (F.xxhash64(F.col(text_col)) == F.col("__ds_h"))
    gone, twice = (marked.where(x).select("__ds_id", "__ds_h") for x in ("NOT stays", "stays AND times > 1"))
    left = few_join(docs, gone, same, "left_anti")
    if twice.isEmpty():
        return left
    one = few_join(left, twice, same, "left_semi").withColumn("__ds_h", F.xxhash64(F.col(text_col))).dropDuplicates([id_col, "__ds_h"]).drop("__ds_h")
    return few_join(left, twice, same, "left_anti").union(one)
