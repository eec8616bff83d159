"""Postings with positions as tables: lists that are kept sorted, cursors as predicates, blocks."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.functions.grouping import positions


def upsert(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The last posting of each (term, doc_id) by ``seq``: adding an id again replaces it."""
    names = [c for c in rows.columns if c not in ("term", "doc_id", seq)]
    last = rows.groupBy("term", "doc_id").agg(F.max_by(F.struct(*names), F.col(seq)).alias("p"))
    return last.select("term", "doc_id", *[F.col(f"p.{c}").alias(c) for c in names])


def lists(rows: DataFrame) -> DataFrame:
    """(term, postings, n): each term's postings as one array by doc_id."""
    names = ["doc_id", *[c for c in rows.columns if c not in ("term", "doc_id")]]
    out = rows.groupBy("term").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("postings"))
    return out.withColumn("n", F.size("postings"))


def cursor(rows: DataFrame, term: str, seek: int | None = None) -> DataFrame:
    """A term's postings by doc_id, from the first that isn't below ``seek``."""
    out = rows.where(F.col("term") == term)
    return (out if seek is None else out.where(F.col("doc_id") >= seek)).orderBy("doc_id")


def seek_first(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(term, target, doc_id): the first doc_id that isn't below each target, null past the end."""
    t = targets.select(F.col("term").alias("t"), "target")
    joined = t.join(rows.select("term", "doc_id"), (F.col("term") == F.col("t")) & (F.col("doc_id") >= F.col("target")), "left")
    return joined.groupBy(F.col("t").alias("term"), "target").agg(F.min("doc_id").alias("doc_id"))


def term_freq(found: Column) -> Column:
    """0 when the cursor is past the end."""
    return F.coalesce(found, F.lit(0))


class BlockState(Enum):
    """What is known of the block that a cursor is in."""

    UNSUPPORTED = "unsupported"
    EXHAUSTED = "exhausted"
    READY = "ready"


@dataclass(frozen=True)
class CurrentBlock:
    state: BlockState
    end_doc: int | None = None
    max_term_freq: int | None = None


def current_block(states: DataFrame | None, term: str, at: int | None) -> CurrentBlock:
    """The block of a term's cursor at document ``at``: the first that doesn't end before it. Without a table of states there is none to tell of; None is past the end."""
    if states is None:
        return CurrentBlock(BlockState.UNSUPPORTED)
    if at is None:
        return CurrentBlock(BlockState.EXHAUSTED)
    found = states.where((F.col("term") == term) & (F.col("end_doc") >= at)).orderBy("end_doc").first()
    return CurrentBlock(BlockState.READY, found["end_doc"], found["max_term_freq"]) if found else CurrentBlock(BlockState.EXHAUSTED)


def block_states(rows: DataFrame, size: int = 1) -> DataFrame:
    """(term, block_no, end_doc, max_term_freq); a cursor in memory has blocks of one posting."""
    by = Window.partitionBy("term").orderBy("doc_id")
    numbered = rows.withColumn("block_no", F.floor((F.row_number().over(by) - 1) / max(1, size)))
    return numbered.groupBy("term", "block_no").agg(F.max("doc_id").alias("end_doc"), F.max("tf").alias("max_term_freq"))


def with_positions(tokens: DataFrame, id_col: str = "doc_id", terms_col: str = "terms") -> DataFrame:
    """(term, doc_id, tf, positions) from arrays of terms.

    A row has all tokens of its document and is grouped where it is read; only
    the rows of ids that occur again are shuffled.
    """
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(terms_col).alias("terms"))
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    repeated = bool(again.limit(1).collect())
    made = T.StructType([T.StructField("term", T.StringType()), rows.schema["doc_id"], T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    out = (rows.join(again, same, "left_anti") if repeated else rows).mapInArrow(positions, made)
    if not repeated:
        return out
    each = rows.join(again, same, "left_semi").select("doc_id", F.posexplode("terms").alias("position", "term"))
    return out.unionByName(each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions")))
