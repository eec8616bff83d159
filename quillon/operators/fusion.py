"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.collect import hit_order


@dataclass(frozen=True)
class FusionConfig:
    k: float = 60.0

    def __post_init__(self) -> None:
        if not (math.isfinite(self.k) and self.k > 0):
            raise ValueError("k must be finite and positive")


@dataclass(frozen=True)
class RankedResult:
    id: str
    rank: int

    def __post_init__(self) -> None:
        if self.rank < 1:
            raise ValueError("ranks start at 1")


def ranked(spark, lists: list[list[RankedResult]]) -> DataFrame:
    """(list_id, id, rank) from lists on the driver."""
    return spark.createDataFrame([(i, r.id, r.rank) for i, rows in enumerate(lists) for r in rows], "list_id int, id string, rank int")


def as_ranked(hits: DataFrame, list_id: int, k: int) -> DataFrame:
    """The best k hits of a query as a ranked list, ids as strings. Numbering k rows in one task is what top-k has come to anyway."""
    best = hits.orderBy(*hit_order()).limit(k)
    rank = F.row_number().over(Window.orderBy(*hit_order()))
    return best.select(F.lit(list_id).alias("list_id"), F.col("doc_id").cast("string").alias("id"), rank.alias("rank"))


def fuse(lists: DataFrame, config: FusionConfig = FusionConfig(), limit: int | None = None) -> DataFrame:
    """(id, score, rank). A list's best rank of an id counts; ranks are summed in order, so the order of rows and lists changes nothing.

    Equal scores go by the best rank, then by the greater id. With ``limit``
    only so many rows are ever brought together for numbering.
    """
    best = lists.groupBy("list_id", "id").agg(F.min("rank").alias("rank"))
    per = best.groupBy("id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    k = F.lit(float(config.k))
    score = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + 1.0 / (k + r))
    scored = per.select("id", score.alias("score"), F.element_at("ranks", 1).alias("best"))
    order = [F.desc("score"), F.asc("best"), F.desc("id")]
    if limit is not None:
        scored = scored.orderBy(*order).limit(limit)
        return scored.select("id", "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    from quillon.sources.index import numbered

    return numbered(scored, order, "n").select("id", "score", (F.col("n") + 1).cast("int").alias("rank"))
