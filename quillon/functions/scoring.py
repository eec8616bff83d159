"""Scores as columns, and as floats for known answers."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import NonFiniteScore

FLOAT_MAX = 3.4028234663852886e38
FLOAT_EPSILON = 1.1920928955078125e-07


def score(value: float) -> float:
    """A finite score, or NonFiniteScore."""
    if not math.isfinite(value):
        raise NonFiniteScore(str(value))
    return float(value)


#: The scores that have a name.
ZERO, ONE, MIN, MAX = 0.0, 1.0, -FLOAT_MAX, FLOAT_MAX


def saturated(value: float) -> float:
    if math.isnan(value):
        return 0.0
    return max(-FLOAT_MAX, min(FLOAT_MAX, value))


def added(a: float, b: float) -> float:
    return saturated(a + b)


def subtracted(a: float, b: float) -> float:
    return saturated(a - b)


def saturate(c: Column) -> Column:
    """NaN becomes 0, what is out of a float's range its ends."""
    return F.when(F.isnan(c), F.lit(0.0)).when(c > FLOAT_MAX, F.lit(FLOAT_MAX)).when(c < -FLOAT_MAX, F.lit(-FLOAT_MAX)).otherwise(c)


def score_text(c: Column) -> Column:
    return F.format_string("%.4f", c.cast("double"))


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if not (math.isfinite(self.k1) and self.k1 >= 0):
            raise ValueError("k1 must be finite and not negative")
        if not 0 <= self.b <= 1:
            raise ValueError("b must be between 0 and 1")

    def with_k1(self, k1: float) -> Bm25Params:
        return replace(self, k1=k1)

    def with_b(self, b: float) -> Bm25Params:
        return replace(self, b=b)


def idf(doc_count: float, df: float) -> float:
    return math.log((doc_count - df + 0.5) / (df + 0.5) + 1)


@dataclass(frozen=True)
class FieldStats:
    field_id: int
    term_frequency: float
    field_length: float
    weight: float = 1.0


@dataclass(frozen=True)
class ScoringStats:
    term_frequency: float
    doc_length: float
    avg_doc_length: float
    doc_count: int
    doc_frequency: int
    field_stats: tuple[FieldStats, ...] = ()


class Scorer(Protocol):
    """Scores by known numbers, or a posting's tf and dl columns; a score of None is no score."""

    needs_positions: bool
    needs_field_stats: bool

    def score(self, stats: ScoringStats) -> float | None: ...

    def column(self, tf: Column, dl: Column, avgdl: float, doc_count: int, df: int) -> Column: ...


def _bm25(tf: float, dl: float, avgdl: float, n: int, df: int, p: Bm25Params) -> float:
    if tf == 0 or n == 0 or df == 0 or df > n or not math.isfinite(avgdl) or avgdl <= 0:
        return 0.0
    norm = 1 - p.b + p.b * dl / avgdl
    return saturated(idf(n, df) * tf * (p.k1 + 1) / (tf + p.k1 * norm))


def bm25_column(tf: Column, dl: Column, avgdl: Column, doc_count: Column, df: Column, params: Bm25Params = Bm25Params()) -> Column:
    """BM25 of columns; 0 where a statistic makes no sense."""
    norm = 1 - params.b + params.b * dl / avgdl
    weight = F.ln((doc_count - df + 0.5) / (df + 0.5) + 1)
    value = weight * (tf * (params.k1 + 1)) / (tf + params.k1 * norm)
    bad = (tf == 0) | (doc_count == 0) | (df == 0) | (df > doc_count) | F.isnan(avgdl) | (avgdl <= 0) | (avgdl == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(saturate(value))


@dataclass(frozen=True)
class Bm25Scorer:
    params: Bm25Params = Bm25Params()
    needs_positions = False
    needs_field_stats = False
    name = "bm25"

    def value(self, stats: ScoringStats) -> float:
        return _bm25(stats.term_frequency, stats.doc_length, stats.avg_doc_length, stats.doc_count, stats.doc_frequency, self.params)

    def score(self, stats: ScoringStats) -> float | None:
        return self.value(stats) or None

    def column(self, tf: Column, dl: Column, avgdl: float | Column, doc_count: int, df: int | Column) -> Column:
        if isinstance(df, Column):
            return bm25_column(tf, dl, avgdl, F.lit(doc_count), df, self.params)
        if doc_count == 0 or df == 0 or df > doc_count or not math.isfinite(avgdl) or avgdl <= 0:
            return F.lit(0.0)
        p = self.params
        top = tf * F.lit(idf(doc_count, df) * (p.k1 + 1))
        value = top / (tf + p.k1 * (1 - p.b + p.b * dl / F.lit(float(avgdl))))
        return F.when(tf == 0, F.lit(0.0)).otherwise(saturate(value))


@dataclass(frozen=True)
class Bm25FScorer(Bm25Scorer):
    """Fields' frequencies and lengths are weighed and summed, then scored once; the engine gives it one field of weight 1."""

    needs_field_stats = True
    name = "bm25f"

    def value(self, stats: ScoringStats) -> float:
        tf = sum(f.term_frequency * f.weight for f in stats.field_stats)
        length = sum(f.field_length * f.weight for f in stats.field_stats)
        return _bm25(tf, length, stats.avg_doc_length, stats.doc_count, stats.doc_frequency, self.params) if tf else 0.0

    def score(self, stats: ScoringStats) -> float | None:
        return (self.value(stats) or None) if stats.field_stats else None


def bm25f_column(fields: Column, avgdl: Column, doc_count: Column, df: Column, params: Bm25Params = Bm25Params()) -> Column:
    """BM25F of an array of structs (tf, dl, weight); null where the array is empty or the score 0."""
    zero = F.lit(0.0)
    tf = F.aggregate(fields, zero, lambda a, x: a + x["tf"] * x["weight"])
    dl = F.aggregate(fields, zero, lambda a, x: a + x["dl"] * x["weight"])
    value = bm25_column(tf, dl, avgdl, doc_count, df, params)
    return F.when(F.size(fields) > 0, F.nullif(value, zero))


@dataclass(frozen=True)
class CombinedScorer:
    """Weighted sum of two scores; where one is missing the other counts alone."""

    first: Scorer
    second: Scorer
    first_weight: float = 1.0
    second_weight: float = 1.0
    name = "combined"

    @property
    def needs_positions(self) -> bool:
        return self.first.needs_positions or self.second.needs_positions

    @property
    def needs_field_stats(self) -> bool:
        return self.first.needs_field_stats or self.second.needs_field_stats

    def score(self, stats: ScoringStats) -> float | None:
        got = [(s.score(stats), w) for s, w in ((self.first, self.first_weight), (self.second, self.second_weight))]
        some = [saturated(s * w) for s, w in got if s is not None]
        return saturated(sum(some)) if some else None

    def column(self, tf: Column, dl: Column, avgdl: float, doc_count: int, df: int) -> Column:
        a, b = (s.column(tf, dl, avgdl, doc_count, df) for s in (self.first, self.second))
        return F.coalesce(combined_column(F.nullif(a, F.lit(0.0)), F.nullif(b, F.lit(0.0)), self.first_weight, self.second_weight), F.lit(0.0))


def combined_column(a: Column, b: Column, a_weight: float = 1.0, b_weight: float = 1.0) -> Column:
    total = F.coalesce(a * a_weight, F.lit(0.0)) + F.coalesce(b * b_weight, F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(saturate(total))
