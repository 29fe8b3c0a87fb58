"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of labelled text. A text is parsed greedily against each automaton:
a phrase runs as long as the automaton can follow (the longest match, one character at least), then the next phrase begins. The number of
phrases, normalised by the size of the training sample as in the entropy estimate phrases * log2(sample) / length, is least for the
language whose text the automaton knows best.

The alphabet is all letters of the samples, with one class for letters that no sample has and one for all that is no letter. An
automaton's edges are a sorted array, searched by (state, letter); the most frequent letters have a dense table (state x class) besides, as
wide as DENSE_BYTES allow for all languages, which changes the speed only. Many texts are parsed at once: a step moves all of a batch's
texts by one character. Long texts are cut into segments of SEGMENT characters, parsed side by side as if a phrase began with each; then
each segment is parsed again from the state in which the one before it ends, up to the first place where both parses begin a phrase. So
the cuts show nowhere: the phrases are those of the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dictspark.llm.common import OWN, give_back, map_arrow, pieces

SEGMENT = 512
#: Classes (the most frequent ones) that may have dense tables, and the bytes of these tables over all languages.
CLASSES, DENSE_BYTES = 64, 256_000_000
UNKNOWN = "und"
#: Bytes of rows whose texts are parsed at once, at most about.
TOGETHER = 4 << 20
#: So few segments at a time go on one by one.
_STRAGGLERS = 48

_LETTER = re.compile(r"[^\W\d_]")  # letters, and numerals such as superscripts


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, pieces_per_lang: int = 192, piece_chars: int = 256) -> dict[str, list[str]]:
    """The labelled sample, bounded by its parameters for each label: the labelled texts are cut, whole, into pieces of piece_chars characters, and
    of each label the pieces_per_lang pieces with the smallest MD5 are taken, so each piece has the same chance wherever it stands. Only
    documents with text, a label and crc32(id as text) mod 3 <> 1. The ranking is cut to pieces_per_lang rows in each task before the
    shuffle. Every label is learned; a worker holds about 1 MB of edges for each."""
    able = docs.where(F.col(lang_col).isNotNull() & (F.col(text_col) != "") & ~held_out(F.col(id_col)))
    piece = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"((?s:.){{1,{piece_chars}}})")))
    able = able.select(F.col(lang_col).alias("lang"), piece.alias("text")).withColumn("h", F.md5("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    out: dict[str, list[str]] = {}
    for lang, text in able.withColumn("rank", rank).where(F.col("rank") <= pieces_per_lang).orderBy("lang", "rank").select("lang", "text").collect():
        out.setdefault(lang, []).append(text)
    return out


def held_out(doc_id):
    """crc32 of the id as text, mod 3, is 1. A null id reads as the empty text, whose checksum is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class Automaton:
    """Transitions of a suffix automaton: state 0 is the root, and a walk from it spells exactly the substrings. Of classes below width,
    dense has a column each; every edge is in keys (state * classes + class, ascending) and to."""

    def __init__(self, step: list[dict[int, int]], classes: int):
        keys = np.array([q * classes + c for q, own in enumerate(step) for c in own], np.int64)
        to = np.array([x for own in step for x in own.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.to, self.classes, self.states = keys[order], to[order], classes, len(step)
        self.widen(0)

    def widen(self, width: int) -> None:
        self.width = min(width, self.classes)
        self.dense = np.full((self.states, self.width), -1, np.int32)
        state, c = np.divmod(self.keys, self.classes)
        own = c < self.width
        self.dense[state[own], c[own]] = self.to[own]

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after class c, -1 where there is no edge."""
        rare = np.flatnonzero(c >= self.width)
        if not len(rare):
            return self.dense.ravel()[state * self.width + c]
        out = self.dense.ravel()[state * self.width + np.minimum(c, self.width - 1)] if self.width else np.full(len(c), -1, np.int32)
        out[rare] = -1
        if len(self.keys):
            key = state[rare] * self.classes + c[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.to[at], -1)
        return out

    def __getitem__(self, at: tuple[int, int]) -> int:
        return int(self.follow(np.array([at[0]], np.int64), np.array([at[1]], np.int64))[0])


def suffix_automaton(s: list[int], classes: int) -> Automaton:
    """The suffix automaton of s, a string over the given number of classes."""
    most = 2 * len(s) + 1
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1] * most, [0] * most, 0
    for c in s:
        new = len(step)
        step.append({})
        length[new], p, last = length[last] + 1, last, new
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
            continue
        q = step[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        copy = len(step)
        step.append(step[q].copy())
        length[copy], link[copy] = length[p] + 1, link[q]
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        link[q] = link[new] = copy
    return Automaton(step, classes)


def phrases_of(s: list[int], step: Automaton) -> int:
    """Greedy phrases of s: the plain form of what Model.phrases does for many texts at once."""
    n, state = 0, -1
    for c in s:
        state = step[state, c] if state >= 0 else -1
        if state < 0:
            n, state = n + 1, step[0, c]
    return n


class Model:
    """Built on each worker from the samples, which are small; the tables are not sent about."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        texts = {lang: self.folded("\n".join(samples[lang])) for lang in self.langs}
        counts = Counter(c for t in texts.values() for c in t if c.isalpha())
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.classes = len(letters) + 2
        self.table = np.zeros(0x110000, np.int32)
        self.table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        self.table[[ord(c) for c in letters]] = np.arange(2, self.classes)
        self.steps = [suffix_automaton(self.coded(texts[lang]).tolist(), self.classes) for lang in self.langs]
        states = sum(step.states for step in self.steps)
        for step in self.steps:
            step.widen(min(CLASSES, DENSE_BYTES // (4 * max(1, states))))
        self.bits = [log2(max(2, len(texts[lang]))) for lang in self.langs]

    @staticmethod
    def folded(text: str) -> str:
        return text.lower()

    def coded(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases by text (coded) and language. Segments are laid out longest first, so each step works on a shrinking head."""
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        cuts = [(t, i) for t, x in enumerate(texts) for i in range(0, len(x), SEGMENT)]
        sizes = np.array([min(SEGMENT, len(texts[t]) - i) for t, i in cuts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((SEGMENT, len(cuts)), np.int32)
        for k, o in enumerate(order.tolist()):
            t, i = cuts[o]
            part = texts[t][i : i + SEGMENT]
            grid[: len(part), k] = part
        owner, size = np.array([t for t, _ in cuts], np.int64)[order], sizes[order]
        place = np.empty(len(cuts), np.int64)
        place[order] = np.arange(len(cuts))
        first = np.array([i == 0 for _, i in cuts], bool)
        after = np.full(len(cuts), -1, np.int64)  # the next segment of the same text
        later = np.flatnonzero(~first)
        after[place[later - 1]] = place[later]
        for j, step in enumerate(self.steps):
            np.add.at(counts[:, j], owner, self._parsed(step, grid, size, after))
        return counts

    def _parsed(self, step: Automaton, grid: np.ndarray, size: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases that begin in each segment (a column of grid, of the given sizes, longest first)."""
        root = step.follow(np.zeros(self.classes, np.int64), np.arange(self.classes))
        alive = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # segments longer than the step
        state, begun = np.full(len(size), -1, np.int64), np.zeros(grid.shape, bool)

        def moved(state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            to = step.follow(np.maximum(state, 0), c)
            lost = (to < 0) | (state < 0)
            to[lost] = root[c[lost]]
            return to, lost

        for s in range(SEGMENT):
            if not (m := int(alive[s])):
                break
            state[:m], begun[s, :m] = moved(state[:m], grid[s, :m])
        n, free = begun.sum(0), state  # of the parse in which a phrase begins with each segment
        total, end = n.copy(), free.copy()
        todo = np.flatnonzero(after >= 0)  # what comes before a segment, whose end may change
        while len(todo):
            own, state, seen = after[todo], end[todo], np.zeros(len(todo), np.int64)
            last, live, alike, s = end[own].copy(), np.arange(len(todo)), np.zeros(len(todo), np.int64), 0
            while len(live) > _STRAGGLERS:
                state[live], lost = moved(state[live], grid[s, own[live]])
                seen[live] += lost
                alike[live] += begun[s, own[live]]
                met = lost & begun[s, own[live]]
                done = live[met]  # from here on, both parses are one
                total[own[done]], last[done] = seen[done] + n[own[done]] - alike[done], free[own[done]]
                s, live = s + 1, live[~met]
                done = live[size[own[live]] <= s]  # ended without meeting
                total[own[done]], last[done] = seen[done], state[done]
                live = live[size[own[live]] > s]
            for k in live.tolist():
                total[own[k]], last[k] = self._one(step, root, grid[:, own[k]], begun[:, own[k]], s, int(size[own[k]]), int(state[k]), int(seen[k]), int(alike[k]), int(n[own[k]]), int(free[own[k]]))
            changed = last != end[own]
            end[own] = last
            todo = own[changed & (after[own] >= 0)]
        return total

    @staticmethod
    def _one(step: Automaton, root: np.ndarray, codes: np.ndarray, begun: np.ndarray, s: int, size: int, state: int, seen: int, alike: int, n: int, free: int) -> tuple[int, int]:
        """(phrases, end) of one segment from character s on, character by character: the few that take long to meet."""
        dense, width = memoryview(step.dense.ravel()), step.width
        for c, other in zip(codes[s:size].tolist(), begun[s:size].tolist(), strict=True):
            alike += other
            if state >= 0:
                state = dense[state * width + c] if c < width else step[state, c]
            if state < 0:
                state = int(root[c])
                seen += 1
                if other:
                    return seen + n - alike, free
        return seen, state

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """lang, score (how much fewer normalised phrases than the second best language, 0 to 1) and bits per character."""
        able = [i for i, t in enumerate(texts) if self.langs and t and has_letter(t)]
        langs, scores, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
        if able:
            coded = [self.coded(self.folded(texts[i])) for i in able]
            rate = self.phrases(coded) * np.array(self.bits)[None, :] / np.array([len(c) for c in coded])[:, None]
            best = rate.argmin(1)
            low = rate[np.arange(len(able)), best]
            rest = rate.copy()
            rest[np.arange(len(able)), best] = np.inf
            second = rest.min(1)
            margin = np.where(np.isfinite(second), 1 - low / np.where(second > 0, second, 1), 1.0)
            for k, i in enumerate(able):
                langs[i], scores[i], bits[i] = self.langs[best[k]], float(np.clip(margin[k], 0, 1)), float(low[k])
        return langs, scores, bits


_MODELS: dict[int, Model] = {}


def _model(key: int, samples: dict[str, list[str]]) -> Model:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(samples)
        give_back()  # what building took beside the automata, before the texts come
    return _MODELS[key]


def with_language(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """docs with __ds_lang, __ds_score and __ds_bits (bits per character against the best language). Null texts and texts without a
    letter are `und` with score 0; so is every text if nothing was learned. Ties go to the language that sorts first."""
    at, key = docs.columns.index(text_col), hash(tuple((k, *v) for k, v in sorted(samples.items())))

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, bits = _model(key, samples).predict(rows.column(at).to_pylist())
        names = [*rows.schema.names, f"{OWN}lang", f"{OWN}score", f"{OWN}bits"]
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, TOGETHER):
                yield found(piece)
        _MODELS.clear()  # a worker outlives its task, and its next one may be another operator's

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{kept}, {OWN}lang string, {OWN}score double, {OWN}bits double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_char. Learns from docs' own labels outside the held-out third.
    Repeated rows get a row each; an empty table gives no rows; further columns of any name are not read."""
    samples = training_sample(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return with_language(rows, samples).select("doc_id", "held_out", F.col(f"{OWN}lang").alias("lang_pred"), F.col(f"{OWN}score").alias("score"), F.col(f"{OWN}bits").alias("bits_per_char"))


#: Bits a character that 64 equally likely symbols take: text that costs more against every language is in none of them.
REJECT_BITS = 6.0
#: Characters that cost nothing in this: a phrase or two of a very short text say little.
REJECT_FREE = 16


def keep_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is found, with their own columns; those without a label get the language found in lang_col. Documents
    without a letter go, and so do those that the parse rejects: their phrases against the best language cost over REJECT_BITS a
    character, REJECT_FREE characters aside. If nothing was learned, as no label is usable, all documents with a letter stay as they are."""
    samples = training_sample(docs, id_col, text_col, lang_col)
    found = with_language(docs, samples if samples else {"": [""]}, text_col).where(F.col(f"{OWN}lang") != UNKNOWN)
    if not samples:
        return found.select(*docs.columns)
    size = F.length(text_col)
    found = found.where(F.col(f"{OWN}bits") * size <= REJECT_BITS * (size + REJECT_FREE))
    filled = F.coalesce(F.col(lang_col), F.col(f"{OWN}lang").cast(docs.schema[lang_col].dataType))
    return found.select(*[filled.alias(c) if c == lang_col else F.col(c) for c in docs.columns])
