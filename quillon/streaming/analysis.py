"""Analysis of a stream of documents. Indexes are immutable, so a stream feeds batches that are each indexed apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.analysis import AnalyzerSpec, terms


def analyzed_stream(docs: DataFrame, id_col: str, text_col: str, spec: AnalyzerSpec) -> DataFrame:
    """(doc_id, position, term): stateless, so it runs the same on a stream and on a table."""
    toks = docs.select(F.col(id_col).alias("doc_id"), terms(F.col(text_col), spec).alias("toks"))
    return toks.select("doc_id", F.posexplode("toks").alias("position", "term"))
