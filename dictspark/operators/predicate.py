"""Predicates over string keys: composable, and compiled to boolean Columns so that Catalyst can push them down.

Own predicates subclass Predicate and give any boolean Column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dictspark.functions.distance import lev_within, osa_near, osa_within


class Predicate:
    def column(self, key: Column) -> Column:
        raise NotImplementedError

    def coarse(self, key: Column) -> Column:
        """A cheap condition that holds for every key accepted; for rows that have yet to be grouped by key."""
        return self.column(key)

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Always(Predicate):
    """Every key."""

    def column(self, key: Column) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Str(Predicate):
    """Keys equal to text."""

    text: str

    def column(self, key: Column) -> Column:
        return key == self.text


@dataclass(frozen=True)
class Prefix(Predicate):
    """Keys that start with text; all keys if it is empty."""

    text: str

    def column(self, key: Column) -> Column:
        return key.startswith(self.text) if self.text else F.lit(True)


@dataclass(frozen=True)
class GreaterThan(Predicate):
    """Keys bytewise above text, or from it on if inclusive."""

    text: str
    inclusive: bool = False

    def column(self, key: Column) -> Column:
        return key >= self.text if self.inclusive else key > self.text


@dataclass(frozen=True)
class LessThan(Predicate):
    """Keys bytewise below text, or up to it if inclusive."""

    text: str
    inclusive: bool = False

    def column(self, key: Column) -> Column:
        return key <= self.text if self.inclusive else key < self.text


@dataclass(frozen=True)
class Lev(Predicate):
    """Keys within a Levenshtein distance of text."""

    text: str
    distance: int

    def column(self, key: Column) -> Column:
        return lev_within(key, self.text, self.distance)


@dataclass(frozen=True)
class Osa(Predicate):
    """Keys within a restricted Damerau-Levenshtein distance of text."""

    text: str
    distance: int

    def column(self, key: Column) -> Column:
        return osa_within(key, self.text, self.distance)

    def coarse(self, key: Column) -> Column:
        return osa_near(key, self.text, self.distance) if self.text else self.column(key)


@dataclass(frozen=True)
class Where(Predicate):
    """Any boolean Column of the key, an Arrow UDF's included."""

    build: Callable[[Column], Column]

    def column(self, key: Column) -> Column:
        return self.build(key)


class _Several(Predicate):
    def __init__(self, *parts: Predicate):
        self.parts = parts


class And(_Several):
    """Keys that all parts accept; all keys without parts."""

    def column(self, key: Column) -> Column:
        return reduce(lambda a, b: a & b, (p.column(key) for p in self.parts), F.lit(True))

    def coarse(self, key: Column) -> Column:
        return reduce(lambda a, b: a & b, (p.coarse(key) for p in self.parts), F.lit(True))


class Or(_Several):
    """Keys that some part accepts; none without parts."""

    def column(self, key: Column) -> Column:
        return reduce(lambda a, b: a | b, (p.column(key) for p in self.parts), F.lit(False))

    def coarse(self, key: Column) -> Column:
        return reduce(lambda a, b: a | b, (p.coarse(key) for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Not(Predicate):
    """Keys that the inner predicate does not accept."""

    inner: Predicate

    def column(self, key: Column) -> Column:
        return ~self.inner.column(key)


@dataclass(frozen=True)
class StartsWith(Predicate):
    """Keys of which some prefix, the empty one and the key itself included, is accepted.

    For exact text, prefixes and lower bounds this is a plain comparison; for others, the prefixes are tried, and for distances only those
    whose length can be near enough."""

    inner: Predicate

    def column(self, key: Column) -> Column:
        p = self.inner
        if isinstance(p, Always | Prefix):
            return p.column(key)
        if isinstance(p, Str):
            return Prefix(p.text).column(key)
        if isinstance(p, LessThan):  # the empty prefix is the least
            return F.lit(p.inclusive or p.text != "")
        if isinstance(p, GreaterThan):  # the key is its own greatest prefix
            return p.column(key)
        if isinstance(p, StartsWith):
            return p.column(key)
        if isinstance(p, Or):
            return Or(*(StartsWith(x) for x in p.parts)).column(key)
        return self._some_prefix(key, p.column)

    def coarse(self, key: Column) -> Column:
        return self._some_prefix(key, self.inner.coarse) if isinstance(self.inner, Osa) else self.column(key)

    def _some_prefix(self, key: Column, accepts: Callable[[Column], Column]) -> Column:
        p, low, high = self.inner, F.lit(0), F.length(key)
        if isinstance(p, Lev | Osa):
            low, high = F.lit(max(0, len(p.text) - p.distance)), F.least(high, F.lit(len(p.text) + p.distance))
        sizes = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.exists(F.transform(sizes, lambda n: F.substring(key, F.lit(1), n)), accepts)
