import re
from collections import defaultdict

import pytest

from dictspark.llm import linedup
from tests.llm.helpers import clashing, docs, rng, sentence


def template(line):
    tokens = [t for t in re.split(rb"[\x20\x09-\x0D]+", line) if t]
    held = ["<*>" if re.search(rb"[0-9]", t) else t for t in tokens]
    return tuple(held if 10 * sum(t != "<*>" for t in held) >= 7 * len(held) else tokens)


def masked(k):
    m = len(k) - linedup.DEPTH
    band = lambda i: (i - linedup.DEPTH) * 8 // m if m >= 8 else i - linedup.DEPTH
    for a in range(min(m, 8)):
        for b in range(a, min(m, 8)):
            shown = tuple("" if i >= linedup.DEPTH and band(i) in (a, b) else t for i, t in enumerate(k))
            if 10 * sum(t not in ("", "<*>") for t in shown) >= 7 * len(k):
                yield a, b, shown


def brute(given, min_docs=2):
    """The tree and its templates in plain Python, over rows (doc_id, text) with distinct ids."""
    at = {}
    for d, t in given:
        for line in linedup.lines_of(t):
            if tokens := template(line):
                at.setdefault(tokens, set()).add(d)
    enough = lambda k, docs: docs >= (max(linedup.MANY, min_docs) if len(k) < linedup.SHORT else min_docs)
    first = {k: min(ds) for k, ds in at.items() if len(ds) > 1 and enough(k, len(ds))}
    groups = defaultdict(list)
    for k in at:
        for key in masked(k):
            groups[key].append(k)
    for own in groups.values():
        held = set().union(*(at[k] for k in own))
        if len(own) > 1 and len(held) > 1 and enough(own[0], sum(len(at[k]) for k in own)):
            for k in own:
                first[k] = min(first.get(k, min(held)), min(held))
    out = []
    for d, t in given:
        lines = t.split("\n") if t else []
        gone = [bool(x) and first.get(x, d) != d for x in map(template, linedup.lines_of(t))]
        out.append((d, "\n".join(x for x, g in zip(lines, gone) if not g) if any(gone) else t, len(lines), sum(gone)))
    return sorted(out)


def cases(seed):
    r = rng(seed)
    long = sentence(r, 60)
    fixed = ["All rights reserved by the owner of this page", "Posted by {} on {} in the general forum of this site", "Short line", "See {} for more about the thing that is told here now"]
    given = []
    for i in range(60):
        lines = [sentence(r, r.randint(1, 40)) for _ in range(r.randint(0, 6))]
        lines += [r.choice(fixed).format(r.choice(["ann", "bob", "cy", "dee"]), r.randint(1, 99)) for _ in range(r.randint(0, 3))]
        if i % 9 == 0:
            lines.append(long)
        if i % 4 == 0:
            lines += ["", "  "]
        r.shuffle(lines)
        given.append((i, "\n".join(lines)))
    numbers = lambda: " ".join(str(r.randint(1, 9)) for _ in range(9))
    given += [(200 + i, f"Total of {r.choice(['red', 'blue'])} things {i} {i}\n{numbers()}\na b c d\nx{i} b c {i % 2} e") for i in range(12)]
    return given + [(100, given[3][1]), (101, given[3][1])]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    given = cases(seed)
    out = linedup.drop_recurring_lines(docs(spark, given).repartition(3).select("doc_id", "text"))
    assert sorted(map(tuple, out.collect())) == brute(given)


def test_what_is_found(spark):
    r = rng(5)
    passage = sentence(r, 55)
    clean = [sentence(r, 30) + "\n" + sentence(r, 20) for _ in range(20)]
    given = [(i, c + ("\n" + passage if i in (4, 9) else "") + (f"\nPosted by user{i} on day {i} in our general forum" if i % 2 else "")) for i, c in enumerate(clean)]
    got = {x["doc_id"]: x["text"] for x in linedup.drop_recurring_lines(docs(spark, given)).collect()}
    assert passage in got[4] and passage not in got[9]
    for i, c in enumerate(clean):
        assert got[i].startswith(c)
        assert ("Posted" in got[i]) == (i == 1)


def test_edge_cases(spark):
    r = rng(6)
    same = sentence(r, 20)
    given = [(1, None), (2, ""), (3, "\n\n \n"), (4, same), (5, same), (5, same), (None, same), (6, sentence(r, 40_000)), (7, "ä ö ü ß é à ñ ç œ\r\nx"), (8, "y\nä ö ü ß é à ñ ç œ\r"), (9, "7 8 9 10 11 12 13 14 15"), (10, "17 18 19 110 111 112 113 114 115")]
    d = clashing(docs(spark, given))
    out = linedup.drop_recurring_lines(d)
    assert out.columns == [*d.columns, "__ds_lines", "__ds_dropped"]
    got = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=repr)
    want = [(1, None), (2, ""), (3, "\n\n \n"), (4, same), (5, ""), (5, ""), (None, ""), (6, given[7][1]), (7, given[8][1]), (8, "y"), (9, given[10][1]), (10, given[11][1])]
    assert got == sorted(want, key=repr)
    assert linedup.drop_recurring_lines(docs(spark, [])).collect() == []
    left = linedup.without_recurring_lines(d)
    assert left.columns == d.columns
    assert sorted((x["doc_id"], x["n_chars"] == len(x["text"] or "")) for x in left.collect()) == [(i, True) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)]


def test_templates_do_not_depend_on_the_leaf(spark):
    """A template with names in two places is found among any number of other lines with the same leading words and length; tables of
    numbers and lines with other words stay; so does a line that only rows of one id hold."""
    r = rng(8)
    names = [sentence(r, 1) + str.upper(sentence(r, 1)) for _ in range(400)]
    filled = [(i, f"It was said by {names[i].strip()} to the people of {names[-i - 1].strip()} that nothing more is known of this today") for i in range(40)]
    other = [(100 + i, "It was said " + sentence(r, 14)) for i in range(300)]
    tables = [(500 + i, " ".join(str(r.randint(1, 99)) for _ in range(12))) for i in range(20)]
    long = [(600 + i, sentence(rng(3), 300) + f" name{'abcdef'[i]} " + sentence(rng(4), 300)) for i in range(3)]
    same = [(700, "one and the same line in rows of one and the same document"), (700, "one and the same line in rows of one and the same document\nmore")]
    got = linedup.drop_recurring_lines(docs(spark, filled + other + tables + long + same)).select("doc_id", "text", "__ds_dropped").collect()
    assert {x["doc_id"] for x in got if x["__ds_dropped"]} == {*range(1, 40), 601, 602}


def test_only_two_tables_are_written(spark, monkeypatch):
    """Every file costs its writer a process; what is read only while the lines' table stays is held on the executors instead."""
    written, plain = [], linedup.stored
    monkeypatch.setattr(linedup, "stored", lambda df, name, *a, **b: written.append(name) or plain(df, name, *a, **b))
    line = "one two three four five six seven eight nine"
    out = linedup.without_recurring_lines(docs(spark, [f"{line}\nfirst of these", f"{line}\nanother text", "a third"]).repartition(3))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: f"{line}\nfirst of these", 1: "another text", 2: "a third"}
    assert written == ["line-rows", "line-gone"]
