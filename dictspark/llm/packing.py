"""Packing into length buckets whose boundaries minimise padding.

The lengths of all documents make a global histogram. Dynamic programming over it chooses the bucket boundaries for which the padding
(each document is padded to its bucket's upper boundary) is least. Within a bucket, documents form batches under a token budget: a batch
holds as many rows as fit at the bucket's length, one at least.

The histogram has a bin for each distinct length, at every size: what reaches the driver is at most about the square root of twice the
number of all words. Up to BINS bins every start of a bucket is tried for every end; beyond that, divide and conquer finds the same
boundaries in bins * log(bins) steps a bucket. Batches are numbered inside cells (a bucket dealt by a hash into
parts of about CELL_ROWS rows), so that no bucket has to be ordered in one task; a cell's last batch may be part-filled. Rows that are the
same in id and text have one hash; where there are more than SAME of them, a random number deals them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictspark.llm.common import OWN, few_join, stored

BINS = 2048
#: More than any padding.
_FAR = np.int64(1 << 62)
CELL_ROWS = 20_000
SAME = CELL_ROWS // 4


def n_tokens(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ends(best: np.ndarray, b: int, size: np.ndarray, number: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, first bin) of bucket b's best start for each end j: bucket b holds bins i..j-1 and is as long as bin j-1. best: the costs of
    b - 1 buckets by end."""
    m = len(size)
    cost, back = np.full(m + 1, _FAR), np.zeros(m + 1, np.int64)
    if m <= BINS:
        for j in range(b, m + 1):
            own = best[b - 1 : j] + size[j - 1] * (number[j] - number[b - 1 : j]) - (total[j] - total[b - 1 : j])
            i = int(own.argmin())
            cost[j], back[j] = own[i], i + b - 1
        return cost, back
    # The padding of a bucket is Monge, so the first best start never moves back as the end moves on: the ends halfway between those done
    # look only between their neighbours' starts. A round does all ends at one depth, over at most 2 m starts.
    left, right, low, high = (np.array([x], np.int64) for x in (b, m, b - 1, m - 1))
    while len(left):
        j = (left + right) // 2
        top = np.minimum(high, j - 1)
        n = top - low + 1
        at = np.cumsum(n) - n
        i = np.arange(n.sum()) + np.repeat(low - at, n)
        ends = np.repeat(j, n)
        own = best[i] + size[ends - 1] * (number[ends] - number[i]) - (total[ends] - total[i])
        least = np.minimum.reduceat(own, at)
        hit = np.flatnonzero(own == np.repeat(least, n))
        first = i[hit[np.searchsorted(hit, at)]]
        cost[j], back[j] = least, first
        left, right, low, high = (np.concatenate(x) for x in ((left, j + 1), (j - 1, right), (low, first), (first, high)))
        some = left <= right
        left, right, low, high = (x[some] for x in (left, right, low, high))
    return cost, back


def optimal_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper boundaries, ascending, of at most n_buckets buckets with the least padding. Of equal choices, the smaller boundary is taken."""
    m = len(lengths)
    if not m:
        return []
    size, count = np.array(lengths, np.int64), np.array(counts, np.int64)
    number, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(size * count)])
    k = min(n_buckets, m)
    best = np.full(m + 1, _FAR)
    best[0] = 0
    back = np.zeros((k + 1, m + 1), np.int64)
    for b in range(1, k + 1):
        best, back[b] = _ends(best, b, size, number, total)
    out, j = [], m
    for b in range(k, 0, -1):
        out.append(int(size[j - 1]))
        j = int(back[b, j])
    return out[::-1]


def histogram(lengths: DataFrame, column: str) -> list[tuple[int, int]]:
    """(length, rows), ascending, of all distinct lengths."""
    return sorted((r[0], r[1]) for r in lengths.groupBy(F.col(column).alias("length")).count().collect())


def _placed(docs: DataFrame, id_col: str, bins: list[tuple[int, int]], n_buckets: int, token_budget: int) -> DataFrame:
    """docs (with their __ds_n_tokens) and __ds_bucket, __ds_bucket_len, __ds_batch_id and __ds_slot. Rows with a __ds_salt are dealt by that."""
    uppers = optimal_boundaries([x for x, _ in bins], [c for _, c in bins], n_buckets) or [0]
    fill = np.zeros(len(uppers), np.int64)
    np.add.at(fill, np.searchsorted(uppers, [x for x, _ in bins]), [c for _, c in bins])
    cells = [max(1, -(-int(c) // CELL_ROWS)) for c in fill]
    tokens, bucket = F.col(f"{OWN}n_tokens"), F.lit(len(uppers) - 1)
    for i in range(len(uppers) - 2, -1, -1):
        bucket = F.when(tokens <= uppers[i], F.lit(i)).otherwise(bucket)
    rows = docs.withColumn(f"{OWN}bucket", bucket).withColumn(f"{OWN}bucket_len", F.get(F.lit(uppers), F.col(f"{OWN}bucket")).cast("long"))
    deal = F.conv(F.substring(f"{OWN}h", 1, 8), 16, 10).cast("long")
    if f"{OWN}salt" in docs.columns:
        deal = F.coalesce(f"{OWN}salt", deal)
    rows = rows.withColumn(f"{OWN}cell", F.pmod(deal, F.get(F.lit(cells), F.col(f"{OWN}bucket"))).cast("int")).drop(f"{OWN}salt")
    each = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col(f"{OWN}bucket_len"), F.lit(1)))).cast("long")
    order = (F.row_number().over(Window.partitionBy(f"{OWN}bucket", f"{OWN}cell").orderBy(f"{OWN}h", id_col)) - 1).cast("long")
    rows = rows.withColumn(f"{OWN}order", order)
    name = F.concat_ws("-", F.col(f"{OWN}bucket"), F.col(f"{OWN}cell"), F.floor(F.col(f"{OWN}order") / each))
    return rows.withColumn(f"{OWN}batch_id", name).withColumn(f"{OWN}slot", F.col(f"{OWN}order") % each).drop(f"{OWN}cell", f"{OWN}order", f"{OWN}h")


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    mark = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    return docs.withColumn(f"{OWN}n_tokens", n_tokens(F.col(text_col))).withColumn(f"{OWN}h", mark)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (from 0), bucket_len, batch_id, slot (from 0 in the batch), padding.

    Null and empty texts have length 0 and are packed like others. Repeated rows get a row each. A document longer than the budget is a
    batch of its own; nothing is cut or left out. An empty table gives no rows; further columns of any name are not read.
    """
    rows = _measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text").drop("text")
    rows = stored(rows.withColumn(f"{OWN}salt", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)), "pack-rows")
    same = stored(rows.groupBy(f"{OWN}h").count().where(F.col("count") > SAME), "pack-same")
    rows = few_join(rows, same, f"{OWN}h", "left").withColumn(f"{OWN}salt", F.when(F.col("count").isNotNull(), F.col(f"{OWN}salt"))).drop("count")
    out = _placed(rows, "doc_id", histogram(rows, f"{OWN}n_tokens"), n_buckets, token_budget)
    own = lambda *names: [F.col(f"{OWN}{n}").alias(n) for n in names]
    return out.select("doc_id", *own("n_tokens", "bucket", "bucket_len", "batch_id", "slot"), (F.col(f"{OWN}bucket_len") - F.col(f"{OWN}n_tokens")).alias("padding"))


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """docs with __ds_n_tokens, __ds_bucket, __ds_bucket_len, __ds_batch_id and __ds_slot: the documents' own columns beside their place. For
    documents without many repeated rows, as near-dedup leaves them: repeated rows share a cell."""
    rows = _measured(docs, id_col, text_col)
    return _placed(rows, id_col, histogram(rows, f"{OWN}n_tokens"), n_buckets, token_budget)
