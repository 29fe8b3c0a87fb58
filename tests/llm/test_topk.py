from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from dictspark.llm import topk
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def brute(rows, every=50, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and isfinite(x) for x in v):
            whole[i, tuple(floor(256 * float(np.float32(x))) for x in v)] = 1
    out = []
    for i, q in whole:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def ask(df, every=50):
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % every == 0).collect()))


@pytest.mark.parametrize("width, spread", [(64, 0.2), (64, 3.0), (7, 1.0), (1, 1.0)])
def test_brute_force(spark, monkeypatch, width, spread):
    monkeypatch.setattr(topk, "CHUNK", 90)
    monkeypatch.setattr(topk, "QUERIES", 5)
    g = np.random.default_rng(width)
    rows = [(i, (g.normal(0, spread, width) + (i % 3)).tolist()) for i in range(400)]
    assert ask(clashing(table(spark, rows)), 20) == brute(rows, 20)


def test_edge_cases(spark):
    g = np.random.default_rng(2)
    own = g.normal(0, 1, 64).tolist()
    rows = [(i, own) for i in range(120)] + [(500 + i, g.normal(0, 1, 64).tolist()) for i in range(20)]
    rows += [(200, None), (201, [None] * 64), (202, [float("nan")] * 64), (203, [float("inf")] + own[1:]), (None, own), (204, [1.0, 2.0]), (205, []), (50, own), (550, own), (206, [-x for x in own])]
    assert ask(table(spark, rows)) == brute(rows)
    assert ask(table(spark, [])) == []
    assert ask(table(spark, [(0, own)])) == []
    assert ask(table(spark, [(0, own), (1, own)])) == brute([(0, own), (1, own)])


def test_large_components_are_exact(spark):
    rows = [(i, [float(1 << 19) * (i + 1), 3.0, float(i)]) for i in range(8)]
    assert ask(table(spark, rows), 4) == brute(rows, 4)


def test_bounds_hold_and_prune():
    g = np.random.default_rng(3)
    x = np.floor(256 * (g.normal(0, 1, (500, 1)) + g.normal(0, 0.2, (500, 64))))
    for s in topk.LEVELS:
        f = topk.features(x, s)
        assert (f @ f.T >= x @ x.T - 1e-6 * np.abs(x @ x.T).max()).all()
    f, ids = [topk.features(x, s) for s in topk.LEVELS], np.arange(500)
    open_ = topk.block_top(ids[:10] + 1000, x[:10], [m[:10] for m in f], np.full(10, -np.inf), ids, x, f, 5)
    assert open_[3] == 1 and len(open_[0]) == 50
    least = open_[2].reshape(10, 5).min(1).astype(float)
    for dense in (0, 1):
        topk_dense, topk._DENSE = topk._DENSE, dense
        held = topk.block_top(ids[:10] + 1000, x[:10], [m[:10] for m in f], least, ids, x, f, 5)
        topk._DENSE = topk_dense
        assert (held[3] < 0.5 or not dense) and all(np.array_equal(a, b) for a, b in zip(open_[:3], held[:3], strict=True))


def test_a_row_that_is_repeated_very_often_lies_in_many_tasks_before_it_counts_once(spark):
    g = np.random.default_rng(5)
    rows = [(i, g.normal(0, 1, 16).tolist()) for i in range(60)] + [(50, g.normal(0, 1, 16).tolist())]
    assert ask(table(spark, rows + rows[:1] * 300)) == brute(rows)
