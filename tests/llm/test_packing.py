from collections import defaultdict
from itertools import combinations

import pytest

from dictspark.llm import packing
from tests.llm.helpers import clashing, docs, rng, sentence


def padding(lengths, counts, uppers):
    return sum((min(u for u in uppers if u >= x) - x) * c for x, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(20))
def test_boundaries_are_optimal(seed):
    r = rng(seed)
    lengths = sorted(r.sample(range(60), r.randint(1, 9)))
    counts = [r.randint(1, 9) for _ in lengths]
    k = r.randint(1, 5)
    got = packing.optimal_boundaries(lengths, counts, k)
    least = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(k) for c in combinations(lengths[:-1], n))
    assert got == sorted(set(got)) and len(got) <= k and got[-1] == lengths[-1]
    assert padding(lengths, counts, got) == least


def check(rows, given, budget, n_buckets):
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=repr) == sorted(((i, len((t or "").split())) for i, t in given), key=repr)
    uppers = sorted({r["bucket_len"] for r in rows})
    batches = defaultdict(list)
    for r in rows:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        assert r["bucket_len"] == min(u for u in uppers if u >= r["n_tokens"])
        batches[r["batch_id"]].append(r)
    for own in batches.values():
        assert len({r["bucket"] for r in own}) == 1 and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0]["bucket_len"] <= budget
    lengths = sorted({r["n_tokens"] for r in rows})
    counts = [sum(r["n_tokens"] == x for r in rows) for x in lengths]
    assert sum(r["padding"] for r in rows) == padding(lengths, counts, packing.optimal_boundaries(lengths, counts, n_buckets))
    return batches


def test_random_and_edge_cases(spark, monkeypatch):
    r = rng(3)
    given = [(i, sentence(r, r.choice([3, 3, 10, 11, 50, r.randint(0, 90)]))) for i in range(300)]
    given += [(1000, None), (1001, ""), (1002, sentence(r, 3_000)), (None, "a b"), (5, "twice here"), (5, "twice here")]
    d = clashing(docs(spark, given))
    batches = check(packing.pack(d, n_buckets=4, token_budget=500).collect(), given, 500, 4)
    full = [b for b in batches.values() if (len(b) + 1) * b[0]["bucket_len"] > 500]
    assert len(full) >= len(batches) - 4  # one part-filled batch a bucket at most
    monkeypatch.setattr(packing, "CELL_ROWS", 50)
    check(packing.pack(d, n_buckets=4, token_budget=500).collect(), given, 500, 4)
    assert packing.pack(docs(spark, [])).collect() == []
    out = packing.packed_documents(d)
    assert out.columns[: len(d.columns)] == d.columns and out.count() == len(given)


def test_many_lengths_go_on_a_grid(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS", 8)
    given = [(i, "w " * i) for i in range(100)]
    rows = packing.pack(docs(spark, given), n_buckets=4, token_budget=400).collect()
    assert len(rows) == 100 and all(r["bucket_len"] >= r["n_tokens"] for r in rows) and len({r["bucket_len"] for r in rows}) <= 4


@pytest.mark.parametrize("seed", range(20))
def test_many_lengths_are_packed_as_well_as_few(seed, monkeypatch):
    """Divide and conquer gives the boundaries of the plain program, ties included."""
    r = rng(seed)
    lengths = sorted(r.sample(range(400), r.randint(1, 120)))
    counts = [r.choice([1, 1, r.randint(1, 50)]) for _ in lengths]
    plain = [packing.optimal_boundaries(lengths, counts, k) for k in range(1, 9)]
    monkeypatch.setattr(packing, "BINS", 0)
    assert [packing.optimal_boundaries(lengths, counts, k) for k in range(1, 9)] == plain


def test_many_lengths_keep_the_least_padding(spark, monkeypatch):
    given = [(i, "w " * i) for i in range(100)] + [(1000, "w " * 5_000)]
    want = packing.optimal_boundaries([*range(100), 5_000], [1] * 101, 4)
    monkeypatch.setattr(packing, "BINS", 8)
    check(packing.pack(docs(spark, given), n_buckets=4, token_budget=400).collect(), given, 400, 4)
    assert sorted({r["bucket_len"] for r in packing.pack(docs(spark, given), n_buckets=4).collect()}) == want


def test_rows_that_are_the_same_lie_in_many_cells(spark, monkeypatch):
    """600 rows with one id and text: dealt over the bucket's cells, each a row of its own, with batches within the budget."""
    monkeypatch.setattr(packing, "CELL_ROWS", 50)
    monkeypatch.setattr(packing, "SAME", 20)
    rows = packing.pack(docs(spark, [(1, "a b c")] * 600 + [(i, "a b") for i in range(2, 30)]), n_buckets=2, token_budget=30).collect()
    own = [r for r in rows if r["doc_id"] == 1]
    cells = {}
    for r in own:
        cells.setdefault(r["batch_id"].split("-")[1], []).append((r["batch_id"], r["slot"]))
    assert len(own) == 600 and len(cells) >= 10 and max(map(len, cells.values())) < 150
    assert len({x for v in cells.values() for x in v}) == 600 and all(slot < 10 for v in cells.values() for _, slot in v)
