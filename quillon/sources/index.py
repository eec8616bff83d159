"""Building, storing and opening an inverted index of DataFrames.

Tables: docs(doc_id, attributes), doc_lengths(doc_id, field_id, dl),
postings(field_id, term, doc_id, tf, dl), terms(field_id, term, df),
field_stats(field_id, doc_count, total_terms). A stored index keeps postings
partitioned by field and sorted by term within files, so a query's terms are
found by row-group statistics. Lengths ride with the postings: a leaf is
scored without a join. tokens(doc_id, field_id, toks, dl) is what analysis
gave, the terms in one string: it is written first, lengths and postings are
derived from it, and phrases are looked for in it. Postings are counted where
documents are read, and lists of some of a term's postings are shuffled once
to the file that they belong to.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial
from itertools import accumulate
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.errors import DuplicateDocument, MissingAnalyzer
from quillon.functions.analysis import BETWEEN, MAX_FIELDS, AnalyzerSpec, FieldAnalyzers, NormalizerSpec, joined_terms
from quillon.functions.grouping import posting_lists
from quillon.storage import stored

BLOCK_SIZE = 2
#: Tokens to a file of postings: at least, while there are fewer files than shuffle partitions, and at most. Tokens that are sampled for the files' bounds.
FEW, MANY, SAMPLED = 100_000, 2_000_000, 300_000


class DocumentIndexBuilder(Protocol):
    """What an index builder offers."""

    def register_field_name(self, field_id: int, name: str) -> None: ...

    def from_dataframe(self, df: DataFrame, id_col: str, fields: dict[int, str], attributes: Sequence[str] = ()) -> Index: ...


def numbered(df: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 0 in a total order, or ``within`` each group of these columns, without bringing them, or a group, into one task.

    The ordered table is stored by range with each range's number, so that
    counting the ranges and numbering within them see the same ranges.
    """
    ranged = df.repartitionByRange(*within, *order).withColumn("range__", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    counts = ranged.groupBy("range__", *within).agg(F.count(F.lit(1)).alias("n__"))
    earlier = Window.partitionBy(*within).orderBy("range__").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("range__", *within, (F.sum("n__").over(earlier) - F.col("n__")).alias("before__"))
    rank = F.row_number().over(Window.partitionBy("range__", *within).orderBy(*order)) - 1 + F.col("before__")
    return ranged.join(before, ["range__", *within]).withColumn(name, rank.cast("long")).drop("range__", "before__")


@dataclass
class Index:
    spark: SparkSession
    docs: DataFrame
    doc_lengths: DataFrame
    postings: DataFrame
    analyzers: FieldAnalyzers
    aliases: dict[str, int] = field(default_factory=dict)
    block_size: int = BLOCK_SIZE
    stored_terms: DataFrame | None = None
    known: dict | None = None
    #: (doc_id, field_id, toks, dl): the analysed terms in order, joined.
    tokens: DataFrame | None = None

    # -- statistics, small enough for the driver: one row a field --

    @cached_property
    def field_stats(self) -> DataFrame:
        return self.doc_lengths.groupBy("field_id").agg(F.count(F.lit(1)).alias("doc_count"), F.sum("dl").cast("long").alias("total_terms"))

    @cached_property
    def stats(self) -> dict[int, tuple[int, int]]:
        if self.known:
            return {int(f): tuple(x) for f, x in self.known["fields"].items()}
        return {r["field_id"]: (r["doc_count"], r["total_terms"]) for r in self.field_stats.collect()}

    @cached_property
    def document_count(self) -> int:
        return self.known["documents"] if self.known else self.docs.count()

    def avgdl(self, field_id: int) -> float:
        count, total = self.stats.get(field_id, (0, 0))
        return total / count if count else 0.0

    @cached_property
    def terms(self) -> DataFrame:
        if self.stored_terms is not None:
            return self.stored_terms
        return self.postings.groupBy("field_id", "term").agg(F.count(F.lit(1)).alias("df"))

    # -- dictionary and registry for the planner --

    def resolve_field(self, name: str) -> int | None:
        return self.aliases.get(name)

    def default_fields(self) -> tuple[int, ...]:
        """Fields with documents by id; if there are none, those of the aliases by name."""
        return tuple(sorted(self.stats)) or tuple(self.aliases[name] for name in sorted(self.aliases))

    def analyzed(self, field_id: int, text: str) -> str | None:
        """A query term as the field's analyzer makes it, if that is one token."""
        spec = self.analyzers.get(field_id)
        found = spec.analyze(text) if spec else []
        return found[0][1] if len(found) == 1 else None

    def dictionary(self, wanted: Sequence[tuple[int, str]]) -> dict[tuple[int, str], int]:
        """df of those (field, term) that exist, by one read with the terms pushed down."""
        wanted = sorted(set(wanted))
        if not wanted:
            return {}
        by_field: dict[int, list[str]] = {}
        for f, t in wanted:
            by_field.setdefault(f, []).append(t)
        match = F.lit(False)
        for f, texts in by_field.items():
            match = match | ((F.col("field_id") == f) & F.col("term").isin(texts))
        return {(r["field_id"], r["term"]): r["df"] for r in self.terms.where(match).collect()}

    # -- derived tables --

    @cached_property
    def blocked(self) -> DataFrame:
        """Postings with the number of their block: every ``block_size`` postings of a term by doc_id."""
        return self.blocked_of(self.postings)

    def blocked_of(self, postings: DataFrame) -> DataFrame:
        made = numbered(postings, [F.col("doc_id")], "block_no", ["field_id", "term"])
        return made.withColumn("block_no", F.floor(F.col("block_no") / max(1, self.block_size)).cast("long"))

    @staticmethod
    def blocks_of(blocked: DataFrame) -> DataFrame:
        return blocked.groupBy("field_id", "term", "block_no").agg(F.max("doc_id").alias("end_doc"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count(F.lit(1)).alias("n_postings"))

    @cached_property
    def blocks(self) -> DataFrame:
        return self.blocks_of(self.blocked)

    def term_ids(self) -> DataFrame:
        """(field_id, term, df, term_id): numbered by first document, then field, then term."""
        first = self.postings.groupBy("field_id", "term").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("df"))
        return numbered(first, [F.col("first_doc"), F.col("field_id"), F.col("term")], "term_id").drop("first_doc")

    def term_texts(self, ids: Sequence[int]) -> dict[int, tuple[int, str]]:
        """(field_id, term) of those term ids that exist."""
        return {r["term_id"]: (r["field_id"], r["term"]) for r in self.term_ids().where(F.col("term_id").isin(list(ids))).collect()}

    # -- storage --

    def save(self, path: str) -> Index:
        """Write the tables and statistics, and open what was written."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        if self.tokens is not None:
            # analysis costs most: it runs once
            self.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
            analysed = self.spark.read.schema(self.tokens.schema).parquet(f"{path}/tokens")
            analysed.select("doc_id", "field_id", "dl").write.mode("overwrite").parquet(f"{path}/doc_lengths")
        else:
            self.doc_lengths.write.mode("overwrite").parquet(f"{path}/doc_lengths")
        lengths = self.spark.read.parquet(f"{path}/doc_lengths").groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").cast("long").alias("t"))
        fields = {r["field_id"]: [r["n"], r["t"]] for r in sorted(lengths.collect())}
        # a field at a time, as a write by field would sort the postings themselves; none of those that were there before stays
        none = self.spark.range(0).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in self.postings.schema])
        none.write.mode("overwrite").partitionBy("field_id").parquet(f"{path}/postings")
        for f, (_, total) in fields.items():
            if self.tokens is not None:
                own = analysed.where(F.col("field_id") == f)
                bounds = self._bounds(own, total)
                lists = lists_of(own, self.escaped, bounds).repartitionById(len(bounds) + 1, F.col("part"))
                ordered = postings_in(lists.sortWithinPartitions("term", F.col("posts")[0]["doc_id"]))
            else:
                ordered = self.postings.where(F.col("field_id") == f).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
            ordered.drop("field_id").write.mode("overwrite").parquet(f"{path}/postings/field_id={f}")
        written = _read_postings(self.spark, path, self.postings.schema)
        found = written.groupBy("field_id", "term").agg(F.count(F.lit(1)).alias("df"))
        found.repartitionByRange("field_id", "term").sortWithinPartitions("field_id", "term").write.mode("overwrite").parquet(f"{path}/terms")
        specs = {}
        for f in range(MAX_FIELDS):
            spec = self.analyzers.get(f)
            if spec is not None and spec.builtin:
                specs[f] = [[n.form, n.case] for n in spec.normalizers]
        meta = {
            "documents": self.spark.read.parquet(f"{path}/docs").count(),
            "fields": fields,
            "aliases": self.aliases, "block_size": self.block_size, "analyzers": specs, "tokens": self.tokens is not None,
        }
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return Index.open(self.spark, path, self.analyzers)

    @property
    def escaped(self) -> frozenset[int]:
        return frozenset(f for f in range(MAX_FIELDS) if (spec := self.analyzers.get(f)) is not None and not spec.builtin)

    def _bounds(self, tokens: DataFrame, total: int) -> tuple[str, ...]:
        """The least terms of all files of a field's postings but the first, so that they are about equal; from a sample, as nothing but their sizes depends on them."""
        n = max(min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / FEW)), math.ceil(total / MANY))
        if n < 2:
            return ()
        some = tokens.sample(min(1.0, SAMPLED / total), 1) if total > SAMPLED else tokens
        counts = sorted(lists_of(some, self.escaped).groupBy("term").agg(F.sum(F.size("posts")).alias("n")).collect())
        ends = list(accumulate(c["n"] for c in counts))
        return tuple(counts[bisect_right(ends, ends[-1] * i // n)]["term"] for i in range(1, n)) if ends else ()

    @classmethod
    def open(cls, spark: SparkSession, path: str, analyzers: FieldAnalyzers | None = None) -> Index:
        """A stored index. Analyzers of built-in kinds are stored too; others have to be given again."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if analyzers is None:
            analyzers = FieldAnalyzers({int(f): AnalyzerSpec(tuple(NormalizerSpec(*n) for n in specs)) for f, specs in meta["analyzers"].items()})
        docs, lengths = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/doc_lengths")
        schema = T.StructType([T.StructField("field_id", T.IntegerType()), T.StructField("term", T.StringType()), docs.schema["doc_id"], T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
        tokens = spark.read.parquet(f"{path}/tokens") if meta["tokens"] else None
        if tokens is not None and isinstance(tokens.schema["toks"].dataType, T.ArrayType):
            tokens = tokens.withColumn("toks", F.array_join("toks", BETWEEN))  # as it was stored before
        return cls(spark, docs, lengths, _read_postings(spark, path, schema), analyzers, meta["aliases"], meta["block_size"], spark.read.parquet(f"{path}/terms"), meta, tokens)


def _read_postings(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/postings").select("field_id", "term", "doc_id", "tf", "dl")


def lists_of(tokens: DataFrame, escaped: frozenset[int] = frozenset(), bounds: tuple[str, ...] = ()) -> DataFrame:
    """(field_id, term, part, posts) of (doc_id, field_id, toks, dl): a term's postings of some documents."""
    post = T.StructType([tokens.schema["doc_id"], T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
    made = T.StructType([T.StructField("field_id", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("posts", T.ArrayType(post))])
    return tokens.select("doc_id", "field_id", "toks", "dl").mapInArrow(partial(posting_lists, escaped=escaped, bounds=bounds), made)


def postings_in(lists: DataFrame) -> DataFrame:
    """(field_id, term, doc_id, tf, dl)"""
    return lists.select("field_id", "term", F.inline("posts"))


class IndexBuilder:
    """Analyzers by field, names of fields, then a DataFrame of documents."""

    def __init__(self, analyzers: FieldAnalyzers, block_size: int = BLOCK_SIZE):
        self.analyzers, self.block_size = analyzers, block_size
        self.aliases: dict[str, int] = {}

    def register_field_alias(self, field_id: int, name: str) -> IndexBuilder:
        """A name for a field; the last registration of a name counts."""
        self.aliases[name] = field_id
        return self

    register_field_name = register_field_alias

    def from_dataframe(self, df: DataFrame, id_col: str, fields: dict[int, str], attributes: Sequence[str] = (), check: bool = True) -> Index:
        """Index text columns; one of type array<string> is a field that a document repeats.

        A null text is a field that the document lacks; an empty one has length 0
        and counts in the field's statistics. ``check`` looks for repeated ids.
        """
        for f in fields:
            if self.analyzers.get(f) is None:
                raise MissingAnalyzer(f)
        attributes = [a for a in attributes if a != "doc_id"]
        docs = df.select(df[id_col].alias("doc_id"), *[df[a] for a in attributes])
        if check:
            again = docs.groupBy("doc_id").count().where("count > 1").limit(1).collect()
            if again:
                raise DuplicateDocument(again[0]["doc_id"])
        parts = []
        for f, name in sorted(fields.items()):
            text, spec = df[name], self.analyzers.get(f)
            if isinstance(df.schema[name].dataType, T.ArrayType):
                each = df.select(df[id_col].alias("doc_id"), F.posexplode(text).alias("i", "t"))
                one = each.where("t is not null").select("doc_id", joined_terms(F.col("t"), spec).alias("x"))
                one = one.groupBy("doc_id").agg(F.collect_list("x").alias("all"))
                toks = F.array_join(F.transform(F.filter("all", lambda x: x["dl"] > 0), lambda x: x["toks"]), BETWEEN)
                one = one.select("doc_id", F.struct(toks.alias("toks"), F.aggregate("all", F.lit(0), lambda a, x: a + x["dl"]).alias("dl")).alias("x"))
            else:
                one = df.where(text.isNotNull()).select(df[id_col].alias("doc_id"), joined_terms(text, spec).alias("x"))
            parts.append(one.select("doc_id", F.lit(f).alias("field_id"), "x.toks", "x.dl"))
        empty = df.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], T.StructField("field_id", T.IntegerType()), T.StructField("toks", T.StringType()), T.StructField("dl", T.IntegerType())]))
        rows = parts[0] if parts else empty
        for p in parts[1:]:
            rows = rows.unionByName(p)
        lengths = rows.select("doc_id", "field_id", "dl")
        made = Index(df.sparkSession, docs, lengths, None, self.analyzers, dict(self.aliases), self.block_size, tokens=rows)
        made.postings = postings_in(lists_of(rows, made.escaped))
        return made
