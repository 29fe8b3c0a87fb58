import hashlib
from functools import lru_cache

import numpy as np
import pytest

from dictspark.llm import chat
from tests.llm.helpers import clashing, rng

ROLES = ["system", "user", "assistant", "Human", "gpt", "tool", None, ""]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def least(roles):
    """The least cost by trying everything, from the rules alone."""
    order = [chat.role_of(r) for r in roles]

    @lru_cache(None)
    def cost(i, state):
        if i == len(order):
            return {0: 0, 1: 6, 2: 3, 3: 0}[state]
        legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
        tries = [(0 if r == order[i] else 2) + cost(i + 1, r) for r in legal[state]]
        if state:
            tries.append(1 + (0 if state == order[i] else 2) + cost(i + 1, state))
        tries += [3 + (0 if r == order[i] else 2) + cost(i + 1, r) for p in legal[state] for r in legal[p]]
        return min(tries)

    return cost(0, 0)


def legal(text):
    roles = [x.split("|>\n")[0] for x in text.split("<|")[1:] if not x.startswith("end")]
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return len(rest) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest)) and text.count("<|end|>\n") == len(roles)


def ordered(rows):
    """role and text by conversation, in the order of the turns."""
    out = {}
    for c, t, role, text in rows:
        h = hashlib.md5(text.encode()).hexdigest() if text is not None else None
        out.setdefault(c, []).append(((t is None, t or 0), (role is None, role or ""), (h is None, h or ""), role, text))
    return {c: [x[3:] for x in sorted(own, key=lambda x: x[:3])] for c, own in out.items()}


def plain(rows):
    """The rows from each conversation as a whole."""
    out = []
    for c, own in ordered(rows).items():
        out += [x[:7] for x in chat._piece(c, 0, len(own), chat.START, [chat.role_of(r) for r, _ in own], [t for _, t in own], chat.CLOSING)]
    return sorted(out, key=lambda x: repr(x[:2]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda x: repr(x[:2]))


@pytest.mark.parametrize("turns, ranges", [(256, 3), (2, 5), (3, 1)])
def test_least_cost_and_legal(spark, monkeypatch, turns, ranges):
    monkeypatch.setattr(chat, "PART_TURNS", turns)
    r = rng(turns)
    convs = {c: [r.choice(ROLES) for _ in range(r.randint(1, 9))] for c in range(80)}
    convs[200] = [r.choice(ROLES) for _ in range(700)]
    rows = [(c, t, role, f"{c}.{t}") for c, roles in convs.items() for t, role in enumerate(roles)]
    r.shuffle(rows)
    own = got(chat.format_chats(clashing(table(spark, rows)), ranges=ranges))
    if turns == 256:  # in workers, the module's own value holds
        assert own == plain(rows)
    parts = {}
    for x in sorted(own, key=lambda x: x[:2]):
        parts.setdefault(x[0], []).append(x)
    assert set(parts) == set(convs)
    for c, p in parts.items():
        text = "".join(x[6] for x in p)
        assert [x[1] for x in p] == list(range(len(p)))
        assert sum(x[4] for x in p) == least(tuple(convs[c])), (c, convs[c])
        assert legal(text) and sum(x[2] for x in p) == len(convs[c]) and sum(x[3] for x in p) == text.count("<|end|>\n")
        at = [text.index(f"\n{c}.{t}\n" if f"\n{c}.{t}\n" in text else f"\n{c}.{t}<") for t in range(len(convs[c]))]
        assert at == sorted(at)  # every turn's text is there, in order


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_the_dealing_shows_nowhere(spark, ranges):
    r = rng(17)
    rows = [(c, t, r.choice(ROLES), f"{c}.{t}") for c in range(12) for t in range(r.choice([2, 5, 256, 257, 600]))]
    assert got(chat.format_chats(table(spark, rows), ranges=ranges)) == plain(rows)


def test_rendering(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c<|end|>"), (2, 0, "assistant", "hi"), (3, 5, "system", None), (3, 6, "user", "q")]
    own = {x[0]: x[6] for x in got(chat.format_chats(table(spark, rows)))}
    assert own[1] == "<|user|>\na\nb<|end|>\n<|assistant|>\nc<\\|end|><|end|>\n"
    assert own[3] == "<|system|>\n<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\n<|end|>\n"
    assert legal(own[2]) and "hi" in own[2]


def test_edge_cases(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (0, 0, "user", "z"), (0, None, "assistant", "last"), (4, 1, "user", "tie b"), (4, 1, "user", "tie a"), (4, 1, "user", "tie a"), (5, 0, None, None), (6, 0, "user", "w " * 100_000)]
    df = chat.format_chats(table(spark, rows))
    assert got(df) == plain(rows)
    own = {x[0]: x for x in got(df)}
    assert own[None][6] == "<|user|>\nx<|end|>\n<|assistant|>\ny<|end|>\n"
    assert own[0][6] == "<|user|>\nz<|end|>\n<|assistant|>\nlast<|end|>\n"
    assert own[4][6].count("tie") == 3 and legal(own[4][6])
    assert legal(own[5][6]) and len(own[6][6]) > 200_000
    assert chat.format_chats(table(spark, [])).collect() == []


def test_matrices():
    r = rng(9)
    for _ in range(50):
        roles = [r.randrange(4) for _ in range(r.randint(2, 8))]
        k = r.randint(1, len(roles) - 1)
        assert np.array_equal(chat.joined(chat.costs(roles[:k]), chat.costs(roles[k:])), chat.costs(roles))
