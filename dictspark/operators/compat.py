"""Predicates with empty patterns as byte-wise automata over characters take them, for those who rely on it.

There, an empty pattern is one character that equals no other: nothing is equal to it or starts with it, every key but the empty one is
above it, only the empty key is below it, and a distance to it is the distance to one character of any kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dictspark.operators.predicate import And, GreaterThan, LessThan, Lev, Not, Or, Osa, Predicate, Prefix, StartsWith, Str, Where


def compat(p: Predicate) -> Predicate:
    """p with empty patterns replaced, at any depth."""
    if isinstance(p, And | Or):
        return type(p)(*(compat(x) for x in p.parts))
    if isinstance(p, Not | StartsWith):
        return type(p)(compat(p.inner))
    if getattr(p, "text", None) != "":
        return p
    if isinstance(p, Str | Prefix):
        return Where(lambda key: F.lit(False))
    if isinstance(p, GreaterThan):
        return Where(lambda key: key != "")
    if isinstance(p, LessThan):
        return Where(lambda key: key == "")
    if isinstance(p, Lev | Osa):
        return Where(lambda key: _near(key, p.distance))
    return p


def _near(key: Column, distance: int) -> Column:
    return F.abs(F.length(key) - 1) <= distance
