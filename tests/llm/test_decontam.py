import hashlib
import re

import numpy as np
import pytest

from dictspark.llm import decontam
from dictspark.llm.common import alnum_hashes
from dictspark.llm.decontam import contamination, drop_contaminated, search
from tests.llm.helpers import clashing, docs, rng, sentence


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def windows(items, size):
    out = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[k : k + size]), set()).add(str(i) if i is not None else "null")
    return out


def brute(given, items, size, slop):
    out = []
    for i, t in given:
        w, hit, own, near = words(t), set(), set(), set()
        for win, ids in windows(items, size).items():
            n = len(win)
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == win:
                    hit |= set(range(p, p + n))
                    own |= ids
            if any(all(any(0 <= p + k + e < len(w) and w[p + k + e] == win[k] for e in range(-slop, slop + 1)) for k in range(n)) for p in range(-n - slop, len(w) + slop)):
                near |= ids
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= 2, len(near)))
    return sorted(out, key=repr)


def cases():
    r = rng(2)
    small = ["aa", "bb", "cc", "dd"]
    items = [(1, sentence(r, 12)), (2, "Short, item!"), (3, None), (4, "!?"), (5, "a a a a a a a a a"), (6, sentence(r, 9, small)), (None, sentence(r, 10)), (10, "Straße ÉCOLE x1 y2 z3")]
    given = [(i, sentence(r, r.randint(0, 80), small)) for i in range(30)] + [(i, sentence(r, 40)) for i in range(30, 40)]
    for k, (_, t) in enumerate(items):
        given.append((100 + k, sentence(r, 9) + " -- " + (t or "").upper() + " ... " + sentence(r, 5)))
        swapped = (t or "").split()
        swapped[1:3] = swapped[1:3][::-1]
        given.append((200 + k, " ".join(swapped)))
    given += [(300, None), (301, ""), (302, "a " * 30), (302, "a " * 30), (None, items[0][1]), (303, (sentence(r, 6_000) + " " + items[0][1] + " ") * 3), (304, "Short"), (305, "item short item")]
    return given, items


@pytest.mark.parametrize("size, slop, block", [(8, 2, 20_000), (8, 2, 3), (3, 1, 20_000), (8, 1, 1)])
def test_brute_force(spark, size, slop, block):
    given, items = cases()
    table = spark.createDataFrame(items + items[:1] * 5, "item_id long, text string")
    out = contamination(docs(spark, given).repartition(3), table, window=size, slop=slop, block_items=block)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(given, items, size, slop)


def test_dropping_and_other_columns(spark):
    given, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    d = clashing(docs(spark, given))
    left = drop_contaminated(d, table)
    assert left.columns == d.columns
    keep = sorted((x[0] for x in brute(given, items, 8, 1) if x[3] == 0), key=repr)
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == keep
    assert search(d, table.limit(0)).where("items IS NOT NULL").collect() == []
    assert contamination(d.limit(0), table).collect() == []
    assert drop_contaminated(d, table.limit(0)).count() == len(given)
    with pytest.raises(ValueError):
        contamination(d, table, window=300).collect()


def test_index(spark, monkeypatch):
    """Each term's positions by segment, whole or limited to some terms; counts over all segments; matches as places of words."""
    d = docs(spark, [(1, "B a b C"), (2, "c c"), (3, None), (None, "b")]).coalesce(1)
    own = decontam.index(d)
    row = own.collect()[0]
    assert (row["ids"], row["words"]) == ([1, 2, 3, None], [4, 2, 0, 1])
    h = np.array([alnum_hashes(t)[0] for t in "abcz"])
    assert np.frombuffer(row["terms"], np.uint64).tolist() == sorted(h[:3].tolist()) and np.frombuffer(row["counts"], np.int32).sum() == 7
    order = np.argsort(h)
    assert decontam.counts(own, h[order])[np.argsort(order)].tolist() == [1, 3, 3, 0]
    few = decontam.index(d, np.sort(h[1:3])).collect()[0]
    assert np.frombuffer(few["terms"], np.uint64).tolist() == sorted(h[1:3].tolist())
    got = decontam.matches(own, spark.createDataFrame([(7, "b c"), (8, "x c")], "item_id long, text string")).collect()
    assert [(r["place"], r["hits"], r["items"], r["near"]) for r in got] == [(0, [2, 3], ["7"], [])]


def test_many_windows_in_bounded_memory(spark):
    """300,000 windows: the block that goes to the workers stays under 64 bytes a window, and the search is of all windows at once."""
    r = rng(9)
    items = [(str(i), sentence(r, 307)) for i in range(1_000)]
    w = decontam.Windows(items, 8)
    assert len(w.rows) == 300_000
    w.rank(np.ones(len(w.terms), np.int64))
    assert sum(x.nbytes for x in (w.rows, w.order, w.items, w.first, w.terms)) < 64 * len(w.rows)
    table = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    given = [(i, sentence(r, 50) + " " + " ".join(items[i][1].split()[20:40]) + " " + sentence(r, 50)) for i in range(20)]
    got = {x["doc_id"]: (x["n_hit"], x["n_items"]) for x in contamination(docs(spark, given), table, slop=0).collect()}
    own, want = windows([(i, t) for i, t in items], 8), {}
    for i, t in given:
        text, hit, ids = words(t), set(), set()
        for p in range(len(text) - 7):
            if found := own.get(tuple(text[p : p + 8])):
                hit |= set(range(p, p + 8))
                ids |= found
        want[i] = len(hit), len(ids)
    assert got == want and all(n >= 20 for n, _ in want.values())


def test_slices(monkeypatch, spark):
    """Many places and small segments: the same rows."""
    monkeypatch.setattr(decontam, "_STRIP", 7)
    given, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    own = decontam.index(docs(spark, given))
    few = decontam.Windows([(str(i), t) for i, t in items if t], 8)
    few.rank(decontam.counts(own, few.terms))
    lists = [decontam.Lists(few, r["terms"], r["counts"], r["positions"], sum(r["words"]) + decontam.GAP * (len(r["words"]) + 1)) for r in own.collect()]
    small = sorted(x for k in lists for w, s, _ in k.search(few, 1) for x in zip(w.tolist(), s.tolist(), strict=True))
    monkeypatch.setattr(decontam, "_STRIP", 1 << 19)
    assert small == sorted(x for k in lists for w, s, _ in k.search(few, 1) for x in zip(w.tolist(), s.tolist(), strict=True)) and small
    assert table.count() == len(items)
