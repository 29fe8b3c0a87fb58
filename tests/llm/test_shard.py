import zlib

import pytest

from dictspark.llm.shard import EDGE, shard_by_bytes
from tests.llm.helpers import clashing, docs, rng, sentence


def check(rows, given, n):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n for r in rows)
    sums = [0] * n
    for s in range(n):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sums[s] = sum(r["size"] for r in own)
    ideal, most = sum(sums) / n, max((r["size"] for r in rows), default=0)
    assert all(abs(s - ideal) <= most + ideal / EDGE for s in sums)


@pytest.mark.parametrize("n", [1, 4, 16])
def test_random(spark, n):
    r = rng(n)
    given = [(i, sentence(r, r.randint(0, 60))) for i in range(400)]
    check(shard_by_bytes(clashing(docs(spark, given)), n).collect(), given, n)


def test_hot_texts_and_nulls(spark):
    r = rng(5)
    given = [(i, "same text") for i in range(300)] + [(1000 + i, "") for i in range(300)] + [(2000, None), (None, "x"), (None, None), (7, "é" * 50_000)] + [(3000 + i, sentence(r, 30)) for i in range(100)] + [(5, "twice"), (5, "twice")]
    rows = shard_by_bytes(docs(spark, given), 8).collect()
    check(rows, given, 8)
    one = sorted((x["shard"], x["slot"]) for x in rows if x["doc_id"] is not None and x["doc_id"] < 300 and x["size"] == 10)
    assert len({s for s, _ in one}) <= 3  # equal texts stand side by side


def test_small_groups_of_equal_texts_are_not_cut(spark):
    r = rng(6)
    texts = [sentence(r, 12) for _ in range(900)]
    given = [(3 * i + c, t) for i, t in enumerate(texts) for c in range(3)]
    rows = shard_by_bytes(docs(spark, given), 4).collect()
    check(rows, given, 4)
    assert all(len({x["shard"] for x in own}) == 1 for own in ([x for x in rows if x["doc_id"] // 3 == i] for i in range(0, 900, 7)))
    groups = {}
    for x in rows:
        groups.setdefault(x["doc_id"] // 3, set()).add(x["shard"])
    assert all(len(g) == 1 for g in groups.values())


def test_rows_that_are_the_same_in_everything(spark):
    given = [(None, "same")] * 500 + [(4, "same")] * 500 + [(5, None)] * 200
    check(shard_by_bytes(docs(spark, given), 8).collect(), given, 8)


def test_small_and_empty(spark):
    assert shard_by_bytes(docs(spark, []), 16).collect() == []
    check(shard_by_bytes(docs(spark, [(1, "a")]), 16).collect(), [(1, "a")], 16)


def test_same_rows_from_any_partitioning(spark):
    r = rng(9)
    d = docs(spark, [sentence(r, r.randint(0, 40)) for _ in range(200)])
    a, b = (sorted(map(tuple, shard_by_bytes(x, 4).collect()), key=repr) for x in (d.repartition(7), d.coalesce(1)))
    assert a == b


def test_native(spark):
    plan = shard_by_bytes(docs(spark, ["a b", "c"]), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
