"""Collectors: what is made of the hits (doc_id, score) of a query."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scoring import FLOAT_MAX


class Collector(Protocol):
    needs_scores: bool
    requires_exhaustive_matches: bool

    def collect(self, hits: DataFrame) -> Any: ...


def hit_order() -> list:
    """Best first: by score, and among equals the greater id."""
    return [F.desc("score"), F.desc("doc_id")]


@dataclass(frozen=True)
class ScoredHit:
    """A hit on the driver. Hits are ordered as hit_order orders rows: ``sorted`` gives the worst first."""

    doc_id: int
    score: float

    @classmethod
    def perfect(cls, doc_id: int) -> ScoredHit:
        return cls(doc_id, 1.0)

    @classmethod
    def zero(cls, doc_id: int) -> ScoredHit:
        return cls(doc_id, 0.0)

    @property
    def is_zero(self) -> bool:
        return self.score == 0

    def __lt__(self, other: ScoredHit) -> bool:
        return (self.score, self.doc_id) < (other.score, other.doc_id)


@dataclass
class TopK:
    """The k best hits; the plan is TakeOrderedAndProject, never a full sort."""

    k: int
    needs_scores = True
    requires_exhaustive_matches = False

    def transform(self, hits: DataFrame) -> DataFrame:
        scored = hits.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
        return scored.orderBy(*hit_order()).limit(self.k)

    def collect(self, hits: DataFrame) -> list:
        # a job runs for k = 0 too, as what is observed of the hits waits for one
        self.rows = TopK(max(1, self.k)).transform(hits).collect()[: self.k]
        return self.rows

    @property
    def min_score(self) -> float | None:
        """What a hit has to reach: nothing until k are held; of k = 0 no hit ever does."""
        if not self.k:
            return FLOAT_MAX
        rows = getattr(self, "rows", [])
        return rows[-1]["score"] if len(rows) == self.k else None

    def can_skip(self, bound: float) -> bool:
        """Only strictly worse hits: an equal score may win by its id."""
        least = self.min_score
        return least is not None and bound < least

    def __len__(self) -> int:
        return len(getattr(self, "rows", []))


@dataclass
class Count:
    """Number of matches, without scores."""

    needs_scores = False
    requires_exhaustive_matches = True

    def transform(self, hits: DataFrame) -> DataFrame:
        return hits.agg(F.count(F.lit(1)).alias("n"))

    def collect(self, hits: DataFrame) -> int:
        self.value = self.transform(hits).first()["n"]
        return self.value


@dataclass
class Hits:
    """All hits as a DataFrame."""

    needs_scores: bool = True
    requires_exhaustive_matches = True

    def collect(self, hits: DataFrame) -> DataFrame:
        return hits


class Group:
    """Several collectors of one execution; it needs scores, or every match, if one of them does."""

    def __init__(self, *collectors: Collector):
        self.collectors = collectors

    @property
    def needs_scores(self) -> bool:
        return any(c.needs_scores for c in self.collectors)

    @property
    def requires_exhaustive_matches(self) -> bool:
        return any(c.requires_exhaustive_matches for c in self.collectors)

    @property
    def min_score(self) -> float | None:
        """The least threshold of the scoring collectors; none if one has none."""
        least = [c.min_score if hasattr(c, "min_score") else None for c in self.collectors if c.needs_scores]
        return min(least) if least and all(x is not None for x in least) else None

    def collect(self, hits: DataFrame) -> list:
        """Top-k and count come from one pass: the count, and the best hits of the largest k, of which the others are prefixes."""
        top = [c for c in self.collectors if isinstance(c, TopK)]
        rest = [c for c in self.collectors if not isinstance(c, (TopK, Count))]
        k = max((c.k for c in top), default=0)
        out: dict[int, Any] = {}
        rows, count = (topk_and_count(hits, k) if top else (None, None)) if len(self.collectors) - len(rest) > 1 else (None, None)
        for i, c in enumerate(self.collectors):
            if isinstance(c, TopK) and rows is not None:
                c.rows = rows[: c.k]
                out[i] = c.rows
            elif isinstance(c, Count) and count is not None:
                c.value = count
                out[i] = count
            else:
                out[i] = c.collect(hits)
        return [out[i] for i in range(len(self.collectors))]


def topk_and_count(hits: DataFrame, k: int) -> tuple[list, int]:
    """Both by one job over the hits: the count is observed as they pass by."""
    from pyspark.sql import Observation

    seen = Observation()
    watched = hits.observe(seen, F.count(F.lit(1)).alias("n"))
    rows = TopK(max(1, k)).transform(watched).collect()
    return rows[:k], seen.get["n"]


def topk_with_count(hits: DataFrame, k: int) -> DataFrame:
    """(doc_id, score, n_matches) as a DataFrame: the count is a sum of partial counts, not a window over all hits."""
    n = hits.agg(F.count(F.lit(1)).alias("n_matches"))
    return TopK(k).transform(hits).crossJoin(F.broadcast(n))
