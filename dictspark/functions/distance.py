"""Edit distances between a key column and a constant pattern, over code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _length_near(key: Column, n: int, d: int) -> Column:
    return F.length(key).between(max(0, n - d), n + d)


def lev_within(key: Column, pattern: str, d: int) -> Column:
    """Levenshtein distance at most d. The threshold form of levenshtein gives -1 beyond d; the length test is cheaper and comes first."""
    return _length_near(key, len(pattern), d) & (F.levenshtein(key, F.lit(pattern), d) >= 0)


def osa_distance(key: Column, pattern: str) -> Column:
    """Restricted Damerau-Levenshtein distance (optimal string alignment): neighbours may be swapped, and what was swapped is not edited again.

    Row by row over the key's characters; the state holds the rows for one and two characters less and the previous character."""
    chars = list(pattern)
    if not chars:
        return F.length(key)
    first = F.array(*[F.lit(i) for i in range(len(chars) + 1)])
    start = F.struct(first.alias("now"), first.alias("before"), F.lit("").alias("prev"), F.lit(0).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        now, before, prev, i = (acc.getField(x) for x in ("now", "before", "prev", "i"))
        cell0 = F.struct((i + 1).alias("last"), F.array(i + 1).alias("row"))

        def cell(row: Column, j: Column) -> Column:
            p, q = F.element_at(F.array(*[F.lit(x) for x in chars]), j), F.get(F.array(*[F.lit(x) for x in chars]), j - 2)
            best = F.least(F.element_at(now, j + 1) + 1, row.getField("last") + 1, F.element_at(now, j) + F.when(c == p, 0).otherwise(1))
            swap = (j > 1) & (i > 0) & (c == q) & (prev == p)
            best = F.when(swap, F.least(best, F.get(before, j - 2) + 1)).otherwise(best)
            return F.struct(best.alias("last"), F.concat(row.getField("row"), F.array(best)).alias("row"))

        row = F.aggregate(F.sequence(F.lit(1), F.lit(len(chars))), cell0, cell).getField("row")
        return F.struct(row.alias("now"), now.alias("before"), c.alias("prev"), (i + 1).alias("i"))

    letters = F.regexp_extract_all(key, F.lit("((?s).)"))
    return F.aggregate(letters, start, step, lambda acc: F.element_at(acc.getField("now"), len(chars) + 1))


def osa_near(key: Column, pattern: str, d: int) -> Column:
    """What OSA distance at most d implies and compiled code can tell: a like length, and a Levenshtein distance of at most 2d."""
    return _length_near(key, len(pattern), d) & (F.levenshtein(key, F.lit(pattern), 2 * d) >= 0)


def osa_within(key: Column, pattern: str, d: int) -> Column:
    """OSA distance at most d. As OSA <= Levenshtein <= 2 * OSA, keys with Levenshtein at most d are in and those beyond 2d are out by compiled
    code. Between, OSA can only be less where a swap is made, so the key must hold two neighbours of the pattern in reverse; only such
    keys pay for the row-by-row expression."""
    if not pattern:
        return F.length(key) <= d
    if d == 0:
        return key == pattern
    swaps = sorted({b + a for a, b in zip(pattern, pattern[1:], strict=False) if a != b})
    if not swaps:
        return lev_within(key, pattern, d)
    swapped = reduce(lambda a, b: a | b, (key.contains(s) for s in swaps))
    lev = F.levenshtein(key, F.lit(pattern), 2 * d)
    return osa_near(key, pattern, d) & F.when(lev <= d, F.lit(True)).when(swapped, osa_distance(key, pattern) <= d).otherwise(F.lit(False))
