"""Exact dedup with static binary-fuse filters.

A snapshot is immutable: the digests of its documents, split into shards of
about a million by digest, get one filter a shard, about nine bits a document.
``Snapshot.save`` stores digests and filters, so that later batches only open
them; a DataFrame as a snapshot gets them for the one call.
An incoming batch sends digests, not texts, to the shards; those that a filter
lets through join the snapshot's documents with the same digest, and texts are
compared byte for byte. To compare them the texts are shuffled by id, at every size:
what is suspect grows with the corpus, so it isn't broadcast. The batch's own duplicates are grouped apart, and
again only texts whose digest occurs twice are compared.

Defined results: equal texts, the empty one included, are duplicates; a null
text is a duplicate of nothing, and nor is a row with a null id. Repeated rows
(same id and text) are duplicates of each other only in keep_one, which leaves
one; in duplicates both refer to the same keeper. The keeper is the least
doc_id: of the snapshot if it has the text, else of the batch. Ids are of any
type that can be ordered; a table is halved in the middle of its ids where
these are whole numbers, and by a hash of them where not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import _base, fuse_filter

SHARD_DIGESTS = 1_000_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2) of rows with a text and an id: a digest of 128 bits in two numbers."""
    d = _base.pick(docs, doc_id=id_col, text=text_col).where("text is not null and doc_id is not null")
    return d.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))


def _shard(shards: int):
    return F.pmod(F.col("h2"), F.lit(shards)).cast("int")


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) from the snapshot's digests; a shard without documents has no row."""

    def make(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "filter": [fuse_filter.build(part["h1"].to_numpy().view(np.uint64))]})

    return snapshot.select(_shard(shards).alias("shard"), "h1").groupBy("shard").applyInPandas(make, "shard int, filter binary")


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The batch's digests that a filter lets through; all true matches are among them."""

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return left.iloc[:0][["doc_id", "h1", "h2"]]
        hit = fuse_filter.contains(bytes(right["filter"].iloc[0]), left["h1"].to_numpy().view(np.uint64))
        return left.loc[hit, ["doc_id", "h1", "h2"]]

    sharded = batch.select("doc_id", "h1", "h2", _shard(shards).alias("shard"))
    return sharded.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, batch.select("doc_id", "h1", "h2").schema)


@dataclass
class Snapshot:
    """A snapshot's documents (doc_id, text), their digests, and filters in so many shards."""

    docs: DataFrame
    digests: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def save(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
        """Write digests and filters to the new folder ``path``; the documents stay where they are."""
        digests(docs, id_col, text_col).write.parquet(f"{path}/digests")
        spark = docs.sparkSession
        old = spark.read.parquet(f"{path}/digests")
        shards = max(1, -(-old.count() // SHARD_DIGESTS))
        build_filters(old, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
        return cls.open(docs, path, id_col, text_col)

    @classmethod
    def open(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
        """The snapshot of ``docs`` that save has stored in ``path``."""
        spark = docs.sparkSession
        filters = spark.read.parquet(f"{path}/filters")
        first = filters.first()
        return cls(_base.pick(docs, doc_id=id_col, text=text_col), spark.read.parquet(f"{path}/digests"), filters.drop("shards"), first["shards"] if first else 1)


def _equal_texts(texts: DataFrame, suspects: DataFrame) -> DataFrame:
    """(doc_id, keeper) among suspects (doc_id, part): the least (part, doc_id) with the same bytes."""
    t = texts.join(suspects.select(F.col("doc_id").alias("sid"), "part", "h1", "h2").distinct().hint("merge"), (F.col("doc_id") == F.col("sid")) & (F.col("of") == F.col("part"))).where("xxhash64(text) = h1").select("doc_id", "part", "text", "h1", "h2")
    t = _base.materialize(t, "suspect_texts")
    least = t.groupBy("h1", "h2", "text").agg(F.min(F.struct("part", "doc_id")).alias("k"))
    named = t.select("doc_id", "part", "text", "h1", "h2").join(least.withColumnRenamed("text", "ktext").hint("merge"), ["h1", "h2"]).where("text = ktext")
    return named.select("doc_id", "part", "h1", F.col("k.doc_id").alias("keeper"), F.col("k.part").alias("keeper_part")).distinct()


def duplicates(batch: DataFrame, snapshot: DataFrame | Snapshot | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keeper, origin) for rows of the batch that duplicate another document.

    origin is "snapshot" or "batch", where the keeper is.
    """
    return _duplicates(batch, snapshot, id_col, text_col).select("doc_id", "keeper", "origin")


def _duplicates(batch: DataFrame, snapshot: DataFrame | Snapshot | None, id_col: str, text_col: str) -> DataFrame:
    new = _base.materialize(digests(batch, id_col, text_col), "batch_digests")
    parts = _base.pick(batch, doc_id=id_col, text=text_col).withColumn("of", F.lit(1))
    twice = new.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2")
    suspects = new.join(twice, ["h1", "h2"], "left_semi").withColumn("part", F.lit(1))
    if snapshot is not None:
        if isinstance(snapshot, DataFrame):
            snapshot = Snapshot.save(snapshot, _base.new_path(batch.sparkSession, "snapshot"), id_col, text_col)
        old = snapshot.digests
        hits = _base.materialize(screen(new, snapshot.filters, snapshot.shards), "hits")
        there = old.join(hits.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
        suspects = suspects.union(hits.select("h1", "h2", "doc_id").join(there, ["h1", "h2"], "left_semi").withColumn("part", F.lit(1)))
        suspects = suspects.union(there.select("h1", "h2", "doc_id").withColumn("part", F.lit(0)))
        parts = parts.union(snapshot.docs.withColumn("of", F.lit(0)))
    suspects = _base.materialize(suspects.select("doc_id", "part", "h1", "h2").distinct(), "suspects")
    found = _equal_texts(parts.where("text is not null"), suspects)
    return found.where("part = 1 and keeper != doc_id").select("doc_id", "h1", "keeper", F.when(F.col("keeper_part") == 0, "snapshot").otherwise("batch").alias("origin"))


def halves(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """An earlier snapshot and a later batch of one table; null ids go to the batch."""
    d, name = _base.plain(docs)
    if not isinstance(docs.schema[docs.columns.index(id_col)].dataType, T.IntegralType):
        first = F.coalesce(F.pmod(F.xxhash64(d[name(id_col)]), F.lit(2)) == 0, F.lit(False)) & d[name(id_col)].isNotNull()
        return d.where(first).toDF(*docs.columns), d.where(~first).toDF(*docs.columns)
    ids = _base.pick(docs, i=id_col).agg(F.min("i").alias("lo"), F.max("i").alias("hi")).first()
    if ids["lo"] is None:
        return docs.where(F.lit(False)), docs
    middle = (ids["lo"] + ids["hi"]) // 2
    i = d[name(id_col)]
    return d.where(i <= middle).toDF(*docs.columns), d.where((i > middle) | i.isNull()).toDF(*docs.columns)


def all_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keeper, origin) over a whole table: its earlier half as a snapshot, itself grouped, its later half as the batch."""
    return _all_duplicates(docs, id_col, text_col).select("doc_id", "keeper", "origin")


def _all_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    old, new = halves(docs, id_col)
    inside = _duplicates(old, None, id_col, text_col).withColumn("origin", F.lit("snapshot"))
    return inside.unionByName(_duplicates(new, old, id_col, text_col))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are no duplicates; one of each set of equal rows. Null ids and null texts stay."""
    found = _all_duplicates(docs, id_col, text_col).select("doc_id", "h1", F.lit(False).alias("again"))
    again = digests(docs, id_col, text_col).groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", "h1", F.lit(True).alias("again"))
    # one table of the rows that don't just stay: texts are shuffled once, and as what is in it grows with the corpus, so at every size
    marked = _base.materialize(found.union(again).select(F.col("doc_id").alias("marked__id"), F.col("h1").alias("marked__h"), "again").distinct(), "marked")
    dropped = marked.where("not again").drop("again")
    d, name = _base.plain(docs)
    i, t = name(id_col), name(text_col)
    same = (d[i] == F.col("marked__id")) & (F.xxhash64(d[t]) == F.col("marked__h"))
    once = d.join(marked.hint("merge"), same, "left_anti")
    # of rows that come again one stays; they are few, or else shuffled once more
    more = _base.materialize(marked.where("again").drop("again").join(dropped, ["marked__id", "marked__h"], "left_anti"), "again")
    return once.union(d.where(d[t].isNotNull()).join(more, same, "left_semi").dropDuplicates([i, t])).toDF(*docs.columns)
