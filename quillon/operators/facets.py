"""Counts of hits by an attribute of their documents; an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.index import Index


def facet_counts(index: Index, hits: DataFrame, attribute: str) -> DataFrame:
    joined = hits.select("doc_id").join(index.docs.select("doc_id", F.col(attribute).alias("value")), "doc_id")
    return joined.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
