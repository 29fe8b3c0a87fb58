"""Chat formatting with minimum-cost role repair.

A legal conversation is: a system turn or none, then user and assistant turns in alternation, ending with an assistant turn. An automaton
with four states accepts these. Dynamic programming over it finds the cheapest repair: a turn keeps its role, takes another (relabel),
joins the turn before it (merge), or an empty turn is put before it (insertion); the repaired sequence is then rendered.

Costs form a (min, +) matrix per run of turns, and matrices of adjoining runs multiply. So long conversations are cut: rows are dealt by
ranges of (conversation, turn), each cut gets its matrix, the matrices of a conversation (16 numbers each) give the costs that lie ahead
of each cut, and with these a cut is repaired by itself. No conversation has to be in one task, and where it was cut shows nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictspark.llm.common import pieces as pieces_of
from dictspark.llm.common import stored

#: A part has so many turns, a cut at most so many and about so many characters.
PART_TURNS, PART_CHARS = 256, 1 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
# Other names of the roles.
ALIASES = {"human": USER, "prompter": USER, "customer": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "ai": ASSISTANT, "model": ASSISTANT, "system": SYSTEM, "user": USER, "assistant": ASSISTANT, "developer": SYSTEM}
MERGE, RELABEL, INSERT = 1, 2, 3
#: Legal next turns of each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Empty turns that complete a conversation in each state.
CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
_INF = 1 << 60


def role_of(name: str | None) -> int:
    """The role's state; START for a name that is none."""
    return ALIASES.get((name or "").strip().lower(), START)


def _moves(state: int, role: int) -> list[tuple[int, int, str, int]]:
    """(cost, new state, what, inserted role or 0) for a turn of this role in this state, in order of preference."""
    out = []
    for r in NEXT[state]:
        out.append((0 if r == role else RELABEL, r, "keep" if r == role else f"relabel:{ROLES[r]}", 0))
    if state != START:
        out.append((MERGE if state == role else MERGE + RELABEL, state, "merge", 0))
    for i in NEXT[state]:
        for r in NEXT[i]:
            out.append((INSERT + (0 if r == role else RELABEL), r, f"insert:{ROLES[i]}+" + ("keep" if r == role else f"relabel:{ROLES[r]}"), i))
    return out


MOVES = {(s, r): _moves(s, r) for s in range(4) for r in range(4)}


def costs(roles: list[int]) -> np.ndarray:
    """Least costs from each state before these turns to each state after them."""
    m = np.full((4, 4), _INF, np.int64)
    for start in range(4):
        now = {start: 0}
        for role in roles:
            after: dict[int, int] = {}
            for s, c in now.items():
                for cost, to, _, _ in MOVES[s, role]:
                    if c + cost < after.get(to, _INF):
                        after[to] = c + cost
            now = after
        for s, c in now.items():
            m[start, s] = c
    return m


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product: costs over two adjoining runs."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), _INF)


def ahead_of(roles: list[int], ahead: list[int]) -> list[list[int]]:
    """Cost from each state before each turn (and after the last) to the end of the conversation; ahead: those after the last turn."""
    out = [ahead]
    for role in reversed(roles):
        out.append([min((cost + out[-1][to] for cost, to, _, _ in MOVES[s, role]), default=_INF) for s in range(4)])
    return out[::-1]


def repaired(roles: list[int], start: int, ahead: list[int]) -> tuple[int, list[tuple[int, str, int]]]:
    """(cost, steps) of the cheapest way on, one step (state after it, what, inserted role) per turn. Of equal ways, each turn takes the first
    of its moves that lies on one; what it takes depends on the costs ahead alone and not on where the conversation was cut."""
    left, steps, total, s = ahead_of(roles, ahead), [], 0, start
    for i, role in enumerate(roles):
        cost, s, what, put = min(MOVES[s, role], key=lambda m: m[0] + left[i + 1][m[1]])  # noqa: B023
        steps.append((s, what, put))
        total += cost
    return total, steps


CLOSING = [INSERT * len(CLOSE[s]) for s in range(4)]


def escaped(text: str | None) -> str:
    """Text cannot form a marker: <| becomes <\\|."""
    return (text or "").replace("<|", "<\\|")


def rendered(texts: list[str | None], steps: list[tuple[int, str, int]], start: int, last: bool) -> tuple[str, int]:
    """The piece of the rendered conversation for these turns (pieces are simply joined) and the number of turns that begin in it."""
    out, turns, opened = [], 0, start != START

    def begin(role: int, text: str) -> None:
        nonlocal turns, opened
        out.append(("<|end|>\n" if opened else "") + f"<|{ROLES[role]}|>\n{text}")
        turns, opened = turns + 1, True

    for text, (state, what, put) in zip(texts, steps, strict=True):
        if what == "merge":
            out.append("\n" + escaped(text))
            continue
        if put:
            begin(put, "")
        begin(state, escaped(text))
    if last:
        for role in CLOSE[steps[-1][0]]:
            begin(role, "")
        out.append("<|end|>\n")
    return "".join(out), turns


_CUTS = "conv_id long, no_id boolean, cut_at long, roles array<int>, texts array<string>, costs array<long>"


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the ordered rows of a range. cut_at orders the cuts of a conversation over all ranges."""
    from pyspark import TaskContext

    at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    rows: list[tuple] = []
    conv: tuple | None = None
    roles: list[int] = []
    texts: list[str | None] = []
    chars, held = 0, 0
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
    names = ["conv_id", "no_id", "cut_at", "roles", "texts", "costs"]

    def close() -> None:
        nonlocal at, roles, texts, chars, held
        if roles:
            rows.append((conv[0], conv[1], at, roles, texts, costs(roles).ravel().tolist()))
            at, roles, texts, chars, held = at + 1, [], [], 0, held + chars

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows.clear()
        return batch

    for batch in batches:
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key = (c, c is None)
            if key != conv or len(roles) >= PART_TURNS or chars >= PART_CHARS:
                close()
                conv = key
            roles.append(role_of(role))
            texts.append(text)
            chars += len(text or "")
            if len(rows) >= 1_000 or held >= 1 << 24:
                yield flush()
                held = 0
    close()
    if rows:
        yield flush()


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per PART_TURNS turns of a conversation (most are one part): conv_id, part (from 0), n_turns (turns in), n_out (turns that begin in
    the part), cost (of the part's repairs), actions (one per turn, and `close:<role>` for empty turns at the end), rendered. The
    renderings of the parts, joined in order, are the rendered conversation.

    Turns are ordered by turn number; ties by role and the text's MD5, nulls last. Rows without a conversation id are one conversation with
    id null. Unknown and null roles can only be relabelled or merged. Null texts are empty turns. Repeated rows are turns of their own
    (they get merged or repaired like others). An empty table gives no rows; further columns of any name are not read. The rows do not
    depend on how the table is dealt.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn"))
    rows = rows.withColumn("h", F.md5("text"))
    order = [F.col(c).asc_nulls_last() for c in ("conv", "turn", "role", "h")]
    n = ranges or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    cuts = stored(ranged.select("conv", "role", "text").mapInArrow(_cuts, _CUTS), "chat-cuts")
    whole = f"{_RESULT}, whole boolean, pos long"

    # Conversations of several cuts: what lies ahead of each cut, then where each begins.
    small = cuts.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), "no_id", "cut_at", F.size("roles").alias("n"), "costs")
    several = small.groupBy("conv", "no_id").agg(F.count("*").alias("cuts")).where("cuts > 1").select("conv", "no_id")
    ahead = small.join(several, ["conv", "no_id"], "left_semi").groupBy("conv", "no_id").applyInPandas(_ahead, "cut_at long, pos long, n_all long, ahead array<long>")
    ahead = stored(ahead, "chat-ahead")
    if ahead.isEmpty():
        return cuts.mapInArrow(_single, whole).drop("whole", "pos")
    of_several = stored(cuts.join(ahead, "cut_at"), "chat-several")
    ends = of_several.select("conv_id", "no_id", "cut_at", "roles", "ahead").mapInArrow(_ends, "conv long, no_id boolean, cut_at long, ends array<int>")
    begins = ends.groupBy("conv", "no_id").applyInPandas(_begins, "cut_at long, begins int")
    pieces = stored(of_several.join(begins, "cut_at").select("conv_id", "pos", "n_all", "begins", "ahead", "roles", "texts").mapInArrow(_pieces, whole), "chat-pieces")
    names = [x.split(" ")[0] for x in _RESULT.split(", ")]
    of = lambda c: F.transform(F.col("own"), lambda x: x[c])
    met = pieces.where("NOT whole").groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in ("n_turns", "n_out", "cost")], F.array_sort(F.collect_list(F.struct("pos", "actions", "rendered"))).alias("own"))
    met = met.withColumns({"actions": F.flatten(of("actions")), "rendered": F.array_join(of("rendered"), "")}).select(*names)
    alone = cuts.join(ahead.select("cut_at"), "cut_at", "left_anti").select(*cuts.columns)
    return alone.mapInArrow(_single, whole).select(*names).union(pieces.where("whole").select(*names)).union(met)


_RESULT = "conv_id long, part int, n_turns long, n_out long, cost long, actions array<string>, rendered string"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int64()]
_NAMES = ["conv_id", "part", "n_turns", "n_out", "cost", "actions", "rendered", "whole", "pos"]


def _ahead(pdf):
    """The cuts of one conversation (16 numbers each): first turn, turns of the conversation, costs from their ends on."""
    import pandas as pd

    pdf = pdf.sort_values("cut_at")
    out = [np.array(CLOSING, np.int64)]
    for c in reversed(pdf.costs.tolist()[1:]):
        out.append(np.minimum((np.array(c, np.int64).reshape(4, 4) + out[-1][None, :]).min(1), _INF))
    n = pdf.n.to_numpy()
    return pd.DataFrame({"cut_at": pdf.cut_at.to_numpy(), "pos": np.cumsum(n) - n, "n_all": int(n.sum()), "ahead": [x.tolist() for x in out[::-1]]})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a cut for each state before it."""
    for batch in batches:
        conv, no_id, cut_at, roles, ahead = (c.to_pylist() for c in batch.columns)
        ends = [[repaired(r, s, a)[1][-1][0] for s in range(4)] for r, a in zip(roles, ahead, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([c or 0 for c in conv], pa.int64()), pa.array(no_id, pa.bool_()), pa.array(cut_at, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], names=["conv", "no_id", "cut_at", "ends"])


def _begins(pdf):
    import pandas as pd

    pdf = pdf.sort_values("cut_at")
    out = [START]
    for e in pdf.ends.tolist()[:-1]:
        out.append(int(e[out[-1]]))
    return pd.DataFrame({"cut_at": pdf.cut_at.to_numpy(), "begins": out})


def _piece(conv: int | None, pos: int, n_all: int, start: int, roles: list[int], texts: list[str | None], ahead: list[int]) -> Iterator[tuple]:
    """Result rows of a cut, cut again where parts begin; whole: the row is all of its part. pos: place of the first turn."""
    _, steps = repaired(roles, start, ahead)
    at = 0
    while at < len(roles):
        part = (pos + at) // PART_TURNS
        to = min(len(roles), (part + 1) * PART_TURNS - pos)
        own, last = steps[at:to], pos + to == n_all
        cost, s = 0, start
        for role, step in zip(roles[at:to], own, strict=True):
            cost += min(c for c, end, what, put in MOVES[s, role] if (end, what, put) == step)
            s = step[0]
        text, begun = rendered(texts[at:to], own, start, last)
        actions = [what for _, what, _ in own]
        if last:
            cost += CLOSING[s]
            actions += [f"close:{ROLES[r]}" for r in CLOSE[s]]
        whole = pos + at == part * PART_TURNS and (last or pos + to == (part + 1) * PART_TURNS)
        yield conv, part, to - at, begun, cost, actions, text, whole, pos + at
        at, start = to, s


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one cut."""
    for whole in batches:
        for batch in pieces_of(whole, 4 << 20):
            conv, roles, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "roles", "texts"))
            if rows := [x for c, r, t in zip(conv, roles, texts, strict=True) for x in _piece(c, 0, len(r), START, r, t, CLOSING)]:
                yield _table(rows)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces_of(whole, 4 << 20):
            if rows := [x for c, pos, n, start, ahead, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in _piece(c, pos, n, start, r, t, ahead)]:
                yield _table(rows)
