"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are made integers (floor(256 * component)). A vector cut into s segments of length L is described by each segment's mean m and
deviation d. The squared distance of two vectors is at least the sum over segments of L * ((m1 - m2)^2 + (d1 - d2)^2); with the norms, the
same statement bounds the inner product from above by the sum of L * (m1 * m2 + d1 * d2). Bounds are taken from coarse to fine (4, then
16 segments); a candidate falls once a bound shows it farther than the k nearest known. Exact integer scores are computed for the
survivors only.

The statistics are computed once and stored with the vectors. Queries (a stated set) are held against all rows in blocks: candidates are
dealt by a hash into chunks of about CHUNK rows, queries into blocks of about QUERIES rows, and each pair of chunk and block is one group.
First all queries are held against one chunk, a random sample of the rows; the k-th best score found there is each query's threshold in
every other group. A group's k best per query go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictspark.llm.common import discard, map_arrow, stored

CHUNK, QUERIES = 8_192, 2_048
SCALE = 256
LEVELS = (4, 16)
#: Query rows for which bounds are held at a time.
_STRIP = 256
#: Where more than this share of a strip's pairs survives the coarsest bound, whole products are cheaper than pairs.
_DENSE = 1 / 16
#: Below this, inner products of a few thousand components are exact in doubles.
_SAFE = float(1 << 20)


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment: the dot product of two rows bounds the vectors' inner product."""
    parts = x.reshape(len(x), segments, -1)
    root = parts.shape[2] ** 0.5
    return np.concatenate([parts.mean(2) * root, parts.std(2) * root], 1)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of q with all of x; beyond doubles' range by Python integers, held to the range of a long."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= _SAFE:
        return (q @ x.T).astype(np.int64)
    exact = q.astype(object) @ x.T.astype(object)
    return np.array([[min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in row] for row in exact], np.int64).reshape(len(q), len(x))


def _all_pairs(q: np.ndarray, fq: list[np.ndarray], enough: np.ndarray, x: np.ndarray, fx: list[np.ndarray], able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(i, j, scores) of all pairs that may be among a row's k best, and how many were scored: whole products, where bounds prune little.
    able: the pairs left by the coarsest bound."""
    for a, b in zip(fq[1:], fx[1:], strict=True):
        able &= a @ b.T >= enough[:, None]
    own = scores(q, x)
    own[~able] = np.iinfo(np.int64).min
    if len(x) > k:  # those below the k-th best fall; ties with it stay
        able &= own >= np.partition(own, len(x) - k, axis=1)[:, len(x) - k, None]
    i, j = np.nonzero(able)
    return i, j, own[i, j], q.shape[0] * len(x)


def _few_pairs(q: np.ndarray, fq: list[np.ndarray], enough: np.ndarray, x: np.ndarray, fx: list[np.ndarray], able: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same pair by pair, where the coarsest bound leaves few."""
    i, j = np.nonzero(able)
    dot = lambda a, b: np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a[i[n : n + (1 << 15)]], b[j[n : n + (1 << 15)]]) for n in range(0, len(i), 1 << 15))])
    for a, b in zip(fq[1:], fx[1:], strict=True):
        keep = dot(a, b) >= enough[i]
        i, j = i[keep], j[keep]
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= _SAFE:
        own = dot(q, x).astype(np.int64)
    else:
        own = np.array([scores(q[a][None, :], x[b][None, :])[0, 0] for a, b in zip(i, j, strict=True)], np.int64)
    return i, j, own, len(i)


def block_top(query_ids: np.ndarray, q: np.ndarray, fq: list[np.ndarray], least: np.ndarray, ids: np.ndarray, x: np.ndarray, fx: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(places of queries, places of candidates, scores) of each query's k best candidates but those of its own id, and the share of pairs
    that were scored exactly. q, x: doubles that hold integers; fq, fx: their features by level; least: the scores that a candidate must
    reach (minus infinity: none)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scored = 0
    slack = 1e-9 * np.linalg.norm(x, axis=1).max(initial=0) * np.linalg.norm(q, axis=1) + 1e-6
    for start in range(0, len(q) if len(x) else 0, _STRIP):
        rows = slice(start, start + _STRIP)
        enough, own_q = least[rows] - slack[rows], [m[rows] for m in fq]
        able = (own_q[0] @ fx[0].T >= enough[:, None]) & (query_ids[rows][:, None] != ids[None, :])
        if able.mean() > _DENSE:
            i, j, own, n = _all_pairs(q[rows], own_q, enough, x, fx, able, k)
        else:
            i, j, own, n = _few_pairs(q[rows], own_q, enough, x, fx, able)
        scored += n
        order = np.lexsort((ids[j], -own, i))
        i, j, own = i[order], j[order], own[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        best = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
        out.append((i[best] + start, j[best], own[best]))
    places, found, own = (np.concatenate([np.empty(0, np.int64), *(o[c] for o in out)]) for c in range(3))
    return places, found, own, scored / max(1, len(q) * len(x))


def _takes_part(values: Column) -> Column:
    """Vectors that take part: not null, without null or non-finite components."""
    return values.isNotNull() & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k candidates with the highest inner product, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Shorter vectors count as padded
    with zeros. A query's own row is no candidate, nor is any other row with its id. Repeated rows (same id and vector) count once.
    Rows that share an id but not a vector are candidates each; as queries, each is ranked by itself. An empty table gives no rows.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & _takes_part(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    size = max(LEVELS[-1], -(-width // LEVELS[-1]) * LEVELS[-1])

    def whole(batches):
        for b in batches:
            x = np.zeros((b.num_rows, size))
            for i, v in enumerate(b.column(1).to_pylist()):
                x[i, : len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
            own = [x, *(features(x, s) for s in LEVELS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in own)], names=["vec_id", "asks", "data", *(f"f{s}" for s in LEVELS)])

    names = ["data", *(f"f{s}" for s in LEVELS)]
    made = map_arrow(rows, whole, "vec_id long, asks boolean, " + ", ".join(f"{c} binary" for c in names))
    rows = stored(made.groupBy("vec_id", *names).agg(F.max("asks").alias("asks")), "top-rows")
    n, n_asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    chunks, blocks = max(1, -(-n // CHUNK)), max(1, -(-n_asked // QUERIES))
    have = rows.select("vec_id", *names, F.pmod(F.xxhash64("vec_id", "data"), F.lit(chunks)).cast("int").alias("chunk"))
    want = rows.where("asks").select(*[F.col(c).alias(c) for c in ("vec_id", *names)], F.pmod(F.xxhash64("vec_id", "data", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    spread = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))

    def matrices(t: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(t.column(c).to_pylist())).reshape(t.num_rows, -1) if t.num_rows else np.empty((0, 1)) for c in names]

    def best(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], kind) for c, kind in (("query_id", pa.int64()), ("data", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64()))})
        (q, *fq), (x, *fx) = matrices(queries), matrices(candidates)
        query_ids, ids = (t.column("vec_id").to_numpy() for t in (queries, candidates))
        least = queries.column("least").to_numpy() if "least" in queries.column_names else np.full(len(q), -np.inf)
        places, found, own, _ = block_top(query_ids, q, fq, least, ids, x, fx, k)
        return pa.table({"query_id": query_ids[places], "data": queries.column("data").take(pa.array(places)), "vec_id": ids[found], "score": own})

    schema = "query_id long, data binary, vec_id long, score long"
    keys = ["chunk", "block"]
    met = lambda a, b: a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(best, schema)
    sample = stored(met(have.where("chunk = 0").withColumn("block", spread(blocks)), want.withColumn("chunk", F.lit(0))), "top-sample")
    found = sample
    if chunks > 1:
        limits = sample.groupBy("query_id", "data").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("least"))
        asked = want.join(limits.withColumnRenamed("query_id", "vec_id"), ["vec_id", "data"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        rest = stored(met(have.where("chunk > 0").withColumn("block", spread(blocks)), asked.withColumn("chunk", F.explode(F.sequence(F.lit(1), F.lit(chunks - 1))))), "top-rest")
        found = sample.union(rest)
    discard(rows)
    rank = F.row_number().over(Window.partitionBy("query_id", "data").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
