"""Sharding by sampled splitters (native: DataFrame functions only).

Law `bytes`: shards get near equal sums of sizes. Rows are ordered by (md5 of the text, id), so equal texts stand side by side; a random
number, stored with each row, orders rows that are the same in both, so any group can be divided. A size-weighted sample of keys gives
quantile boundaries, every row falls into the range between two boundaries, and ranges that turn out overfull are divided by boundaries
from a further sample within them. Exact sums over the ranges and running sums within each place every row on one global axis of bytes,
which is cut into equal shards; so the balance is exact to one record, whatever the sample said. Where a cut falls into a group of equal
texts of at most a hundredth of a shard, it moves to the nearer edge of the group. Only (key, id, size, crc) leaves the scan.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictspark.llm.common import discard, stored

#: Hex digits of the key that choose the list of boundaries a row is held against.
_CELL = 3
#: A group of equal texts of at most a shard's bytes divided by this is not cut.
EDGE = 100


def _weight(n_rows: int, n_bytes: int) -> Column:
    """A record's size plus the mean size: a range of many tiny records fills up too."""
    return F.col("size") + F.lit(max(1.0, n_bytes / max(1, n_rows)))


#: What orders the rows: key, id and the random number; less than any.
_ORDER, _LOW = ("key", "order_id", "salt"), -(1 << 63)


def _range_of(bounds: list[tuple[str, int, int]]) -> Column:
    """Number of boundaries (sorted triples of key, id and random number) at or below the row's. The row's cell, the first digits of its key,
    gives the boundaries that lie before the cell and the few within it; all tables are constants of at most the number of boundaries."""
    cells = [f"{i:0{_CELL}x}" for i in range(16**_CELL)]
    starts = [bisect_right(bounds, (c, _LOW, _LOW)) for c in cells] + [len(bounds)]
    listed = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")  # noqa: E731  folded into one constant
    cell = F.conv(F.substring("key", 1, _CELL), 16, 10).cast("int")
    n = F.get(listed(starts, "int"), cell)
    if not bounds:
        return n
    m = F.get(listed(starts, "int"), cell + 1) - n
    every = [F.slice(listed([b[i] for b in bounds], kind), n + 1, m) for i, kind in enumerate(("string", "bigint", "bigint"))]
    below = lambda x: F.struct(x["0"].alias("k"), x["1"].alias("d"), x["2"].alias("s")) <= F.struct(F.col("key").alias("k"), F.col("order_id").alias("d"), F.col("salt").alias("s"))
    return n + F.size(F.filter(F.arrays_zip(*every), below))


def _sample(rows: DataFrame, want: int, n_rows: int, n_bytes: int, seed: int) -> list[tuple[str, int, int, float]]:
    """About `want` keys, each row drawn with a chance in proportion to its weight (heavier ones surely), with the weight each stands
    for. The draw is a hash of the key, so a repeated task draws the same rows. At most about twice `want` rows reach the driver."""
    w, share = _weight(n_rows, n_bytes), max(1.0, 2 * n_bytes) / want
    u = F.pmod(F.xxhash64(*_ORDER, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(u * share < w).select(*_ORDER, F.greatest(w, F.lit(share)).alias("w")).collect()
    return sorted(tuple(r) for r in drawn)


def _quantiles(drawn: list[tuple[str, int, int, float]], parts: int) -> list[tuple[str, int, int]]:
    total, cut, sofar = sum(x[3] for x in drawn), 1, 0.0
    out = []
    for *key, w in drawn:
        sofar += w
        if cut < parts and sofar >= total * cut / parts:
            out.append(tuple(key))
            cut = int(sofar * parts / total) + 1
    return sorted(set(out))


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 16, sample_per_range: int = 64) -> DataFrame:
    """One row per record: id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 within a shard), grown_shard (null).

    Null text: size 1 and the checksum of no bytes (0). Null ids sort first. Repeated rows keep a row each; they are interchangeable, so
    their order does not matter. An empty table gives no rows. Further columns of any name are not read. At most n_shards *
    ranges_per_shard boundaries (the parameters, not the data) are sent to executors.
    """
    text, n_ranges = F.coalesce(F.col(text_col), F.lit("")), n_shards * ranges_per_shard
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.withColumn("order_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    rows = stored(rows, "shard-rows")
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bounds = _quantiles(_sample(rows, n_ranges * sample_per_range, n_rows, n_bytes, 0), n_ranges) if n_rows else []
    for again in range(1, 4):  # each time, overfull ranges get boundaries of their own
        each = {r[0]: (r[1], r[2], r[3]) for r in rows.groupBy(_range_of(bounds).alias("range")).agg(F.sum("size"), F.count("*"), F.sum(_weight(n_rows, n_bytes))).collect()}
        ideal = 2 * max(1, n_bytes) / n_ranges
        if not (over := [r for r, x in each.items() if x[2] > 2 * ideal and x[1] > 1]):
            break
        part = rows.where(_range_of(bounds).isin(over))
        more, drawn = [], _sample(part, n_ranges * sample_per_range, n_rows, n_bytes, again)
        for r in over:
            low, high = bounds[r - 1] if r else ("", _LOW, _LOW), bounds[r] if r < len(bounds) else ("g", 0, 0)
            more += _quantiles([x for x in drawn if low <= x[:3] < high], int(each[r][2] / ideal) + 1)
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    else:
        each = {r[0]: (r[1], r[2], 0) for r in rows.groupBy(_range_of(bounds).alias("range")).agg(F.sum("size"), F.count("*")).collect()}
    sums, counts = [0], [0]
    for r in range(len(bounds) + 1):
        sums.append(sums[-1] + each.get(r, (0, 0))[0])
        counts.append(counts[-1] + each.get(r, (0, 0))[1])
    within = Window.partitionBy("range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    shard_of = lambda before, size: F.least(F.floor((2 * before + size) * n_shards / F.lit(2 * max(1, n_bytes))).cast("int"), F.lit(n_shards - 1))
    placed = (
        rows.withColumn("range", _range_of(bounds))
        .withColumn("index", F.count(F.lit(1)).over(within) - 1 + F.get(F.lit(counts), "range"))
        .withColumn("before", F.sum("size").over(within) - F.col("size") + F.get(F.lit(sums), "range"))
        .withColumn("shard", shard_of(F.col("before"), F.col("size")))
    )
    placed = stored(placed.select("doc_id", "key", "size", "text_crc32", "shard", "index", "before"), "shard-placed")
    discard(rows)
    # A cut falls into one group at most, so these are fewer than the shards.
    groups = placed.groupBy("key").agg(F.min("shard").alias("x"), F.max("shard").alias("y"), F.min("before").alias("start"), F.sum("size").alias("bytes"))
    cut = groups.where("x < y").where(F.col("bytes") * n_shards * EDGE <= F.lit(n_bytes)).select("key", shard_of(F.col("start"), F.col("bytes")).alias("whole"))
    placed = placed.join(F.broadcast(cut), "key", "left").withColumn("shard", F.coalesce("whole", "shard"))
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
