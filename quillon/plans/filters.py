"""Filters: predicates over document attributes, and filters in numbered slots."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Value = int | float | str


def literal(value: Value) -> Column:
    """A filter value; an integer that a long can't hold is a decimal."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("filter values are finite")
    if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        return F.lit(Decimal(value))
    return F.lit(value)


@dataclass(frozen=True)
class Eq:
    field: str
    value: Value

    def column(self, get: Callable[[str], Column]) -> Column:
        return F.coalesce(get(self.field) == literal(self.value), F.lit(False))


@dataclass(frozen=True)
class Range:
    """Both ends belong to the range; None leaves an end open."""

    field: str
    low: Value | None = None
    high: Value | None = None

    def column(self, get: Callable[[str], Column]) -> Column:
        c = get(self.field)
        out = c.isNotNull()
        if self.low is not None:
            out = out & (c >= literal(self.low))
        if self.high is not None:
            out = out & (c <= literal(self.high))
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[Value, ...] = ()

    def column(self, get: Callable[[str], Column]) -> Column:
        if not self.values:
            return F.lit(False)
        return F.coalesce(get(self.field).isin([literal(v) for v in self.values]), F.lit(False))


@dataclass(frozen=True)
class AllOf:
    parts: tuple[Predicate, ...] = ()

    def column(self, get: Callable[[str], Column]) -> Column:
        return F.forall(F.array(*[p.column(get) for p in self.parts]), lambda x: x) if self.parts else F.lit(True)


@dataclass(frozen=True)
class AnyOf:
    parts: tuple[Predicate, ...] = ()

    def column(self, get: Callable[[str], Column]) -> Column:
        return F.exists(F.array(*[p.column(get) for p in self.parts]), lambda x: x) if self.parts else F.lit(False)


@dataclass(frozen=True)
class NotP:
    """A null attribute makes the inner predicate false, so this one true."""

    part: Predicate

    def column(self, get: Callable[[str], Column]) -> Column:
        return ~F.coalesce(self.part.column(get), F.lit(False))


Predicate = Eq | Range | In | AllOf | AnyOf | NotP


def fields_of(p: Predicate) -> set[str]:
    if isinstance(p, (AllOf, AnyOf)):
        return set().union(*map(fields_of, p.parts))
    return fields_of(p.part) if isinstance(p, NotP) else {p.field}


@dataclass(frozen=True)
class Slots:
    """What an application filters by: for each slot a Column over document attributes, or a table of allowed doc_id.

    A Column may hold a Python UDF, for predicates that can't be said otherwise.
    """

    of: dict[int, Column | DataFrame]

    def slots(self) -> list[int]:
        return sorted(self.of)


NO_FILTER = Slots({})
