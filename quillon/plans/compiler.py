"""A plan as one DataFrame: one scan of the postings of all its terms, one shuffle by document, one expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import UnsupportedFilterPredicate
from quillon.functions.analysis import BETWEEN, AnalyzerSpec, escaped
from quillon.functions.scoring import FLOAT_EPSILON, Scorer, saturate
from quillon.plans.filters import NO_FILTER, Slots, fields_of
from quillon.plans.program import And, ConstantScore, ExecutionPlan, ExternalFilter, Filter, Not, Or, Phrase, Term
from quillon.sources.index import Index

#: With more leaves than this, scores by document are a map and no longer a column each.
WIDE = 16


@dataclass
class Compiled:
    """hits has doc_id, and score if scored; leaves are the postings that were matched, before grouping."""

    hits: DataFrame
    leaves: DataFrame


def _holds(joined: Column, words: tuple[str, ...], slop: int) -> Column:
    """Whether joined tokens hold a phrase: from each first word on, every next word is taken as early as it comes within the slop."""

    def within(toks: Column) -> Column:
        def from_(begin: Column) -> Column:
            end = begin
            for w in words[1:]:
                # a place within the next slop + 1 tokens; null where there is none
                ahead = F.array_position(F.slice(toks, end + 2, slop + 1), w).cast("int")
                end = end + F.nullif(ahead, F.lit(0))
            return F.coalesce(end - begin - (len(words) - 1) <= slop, F.lit(False))

        begins = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.get(toks, i) == words[0])
        return F.exists(begins, from_)

    # a variable of a lambda, so that a text is split once and not for every token
    return F.exists(F.array(F.split(joined, BETWEEN)), within)


class Compiler:
    def __init__(self, index: Index, plan: ExecutionPlan, scorer: Scorer | None, slots: Slots = NO_FILTER, strict: bool = False, precision: str = "double"):
        self.index, self.program, self.scorer, self.slots, self.strict = index, plan.program, scorer, slots, strict
        self.type = {"double": "double", "float": "float"}[precision]
        nodes = self.program.nodes
        self.leaf_of: dict[tuple, int] = {}
        for n in nodes:
            if isinstance(n, Term):
                self.leaf_of.setdefault(("term", n.field_id, n.term), len(self.leaf_of))
            elif isinstance(n, Phrase):
                self.leaf_of.setdefault(("phrase", n.field_id, n.terms, n.slop), len(self.leaf_of))
        used = {n.slot for n in nodes if isinstance(n, ExternalFilter)}
        self.used_slots = {s: f for s, f in slots.of.items() if s in used}
        self.attributes = set().union(*(fields_of(n.predicate) for n in nodes if isinstance(n, Filter)), set())
        if strict and self.attributes:
            raise UnsupportedFilterPredicate("structured filters")

    # -- leaves --

    def _leaves(self) -> DataFrame:
        """(doc_id, leaf, s) of all terms and phrases; s is the score, 0 when nothing is scored."""
        index = self.index
        keys = [k for k in self.leaf_of if k[0] == "term"]
        df = index.dictionary([k[1:] for k in keys]) if self.scorer and keys else {}
        number, score = None, None
        for _, f, t in keys if len(keys) <= WIDE else ():
            here = (F.col("field_id") == f) & (F.col("term") == t)
            n = F.lit(self.leaf_of["term", f, t])
            s = self.scorer.column(F.col("tf"), F.col("dl"), index.avgdl(f), index.document_count, df.get((f, t), 0)) if self.scorer else F.lit(0.0)
            number = F.when(here, n) if number is None else number.when(here, n)
            score = F.when(here, s) if score is None else score.when(here, s)
        found = index.postings.where(self._match(keys))
        if len(keys) > WIDE:
            out = self._many(keys, df)
        elif number is None:
            out = found.select("doc_id", F.lit(0).alias("leaf"), F.lit(0.0).alias("s"))
        else:
            out = found.select("doc_id", number.alias("leaf"), score.cast(self.type).alias("s"))
        for key, n in self.leaf_of.items():
            if key[0] == "phrase":
                out = out.unionByName(self._phrase(*key[1:]).select("doc_id", F.lit(n).alias("leaf"), F.col("s").cast(self.type).alias("s")))
        return out

    def _many(self, keys: list[tuple], df: dict) -> DataFrame:
        """The same for many terms: joined to a table of them, which is broadcast, as plans have a bounded number of nodes."""
        index = self.index
        rows = [(f, t, self.leaf_of["term", f, t], df.get((f, t), 0), float(index.avgdl(f))) for _, f, t in keys]
        table = index.spark.createDataFrame(rows, "of_field int, of_term string, leaf int, df long, avgdl double")
        found = index.postings.where(self._match(keys))
        joined = found.join(F.broadcast(table), (F.col("field_id") == F.col("of_field")) & (F.col("term") == F.col("of_term")))
        s = self.scorer.column(F.col("tf"), F.col("dl"), F.col("avgdl"), index.document_count, F.col("df")) if self.scorer else F.lit(0.0)
        return joined.select("doc_id", "leaf", s.cast(self.type).alias("s"))

    @staticmethod
    def _match(keys: list[tuple]) -> Column:
        match = F.lit(False)
        for field_id in sorted({f for _, f, _ in keys}):
            match = match | ((F.col("field_id") == field_id) & F.col("term").isin([t for _, f, t in keys if f == field_id]))
        return match

    def _phrase(self, field_id: int, words: tuple[str, ...], slop: int) -> DataFrame:
        """Documents where each word follows the one before with at most ``slop`` other tokens in all; the score is the words' sum.

        Documents that hold all the words are found from the postings; the
        order of the words is looked up in the stored tokens of these alone.
        """
        if self.index.tokens is None:
            raise UnsupportedFilterPredicate("phrases need Index.tokens")
        index, distinct = self.index, tuple(dict.fromkeys(words))
        df = index.dictionary([(field_id, w) for w in distinct]) if self.scorer else {}
        score = F.lit(0.0)
        for w in distinct:
            one = self.scorer.column(F.col("tf"), F.col("dl"), index.avgdl(field_id), index.document_count, df.get((field_id, w), 0)) if self.scorer else F.lit(0.0)
            score = F.when(F.col("term") == w, one).otherwise(score)
        found = index.postings.where((F.col("field_id") == field_id) & F.col("term").isin(list(distinct)))
        both = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s")).where(F.col("n") == len(distinct))
        # as they are in joined tokens, which are split only where all of them are
        spec = index.analyzers.get(field_id) or AnalyzerSpec()
        words, all_in = tuple(escaped(w, spec) for w in words), F.lit(True)
        for w in dict.fromkeys(words):
            all_in = all_in & F.concat(F.lit(BETWEEN), F.col("toks"), F.lit(BETWEEN)).contains(BETWEEN + w + BETWEEN)
        toks = index.tokens.where((F.col("field_id") == field_id) & all_in).select("doc_id", "toks").join(both, "doc_id")
        return toks.where(_holds(F.col("toks"), words, slop)).select("doc_id", "s")

    # -- expressions over one document --

    def _fold(self, at: int, matched, scored, memo: dict) -> tuple[Column, Column | None]:
        if at in memo:
            return memo[at]
        n = self.program.nodes[at]
        zero = F.lit(0.0).cast(self.type)
        if isinstance(n, (Term, Phrase)):
            key = ("term", n.field_id, n.term) if isinstance(n, Term) else ("phrase", n.field_id, n.terms, n.slop)
            leaf = self.leaf_of[key]
            m, s = matched(leaf), scored(leaf)
            boost = n.boost if isinstance(n, Term) else 1.0
            s = saturate(s * F.lit(boost).cast(self.type)) if abs(boost - 1) > FLOAT_EPSILON else s
        elif isinstance(n, (And, Or)):
            below = [self._fold(c, matched, scored, memo) for c in n.children]
            if not below:
                m, s = F.lit(False), zero
            else:
                flags = F.array(*[b[0] for b in below])
                m = F.forall(flags, lambda x: x) if isinstance(n, And) else F.exists(flags, lambda x: x)
                adds = F.array(*[F.when(b[0], b[1]).otherwise(zero) for b in below])
                s = F.aggregate(adds, zero, lambda a, x: saturate(a + x).cast(self.type))
                if len(below) == 1:
                    m, s = below[0][0], F.when(*below[0]).otherwise(zero)
            if abs(n.boost - 1) > FLOAT_EPSILON:
                s = saturate(s * F.lit(n.boost).cast(self.type))
        elif isinstance(n, Not):
            m, s = ~self._fold(n.child, matched, scored, memo)[0], zero
        elif isinstance(n, ConstantScore):
            finite = n.score == n.score and abs(n.score) != float("inf")
            m, s = self._fold(n.child, matched, scored, memo)[0], F.lit(float(n.score) if finite else 0.0).cast(self.type)
        elif isinstance(n, Filter):
            m, s = self._fold(n.child, matched, scored, memo)
            m = m & n.predicate.column(lambda name: F.col(f"a__{name}"))
        else:
            m, s = self._fold(n.child, matched, scored, memo)
            m = m & self._slot(n.slot)
        memo[at] = m, s
        return memo[at]

    def _slot(self, slot: int) -> Column:
        if slot not in self.used_slots:
            return F.lit(True)
        return F.coalesce(F.col(f"slot__{slot}"), F.lit(False))

    def _without_leaves(self, at: int, memo: dict) -> bool | None:
        """Whether a document without any leaf matches; None where a filter decides."""
        if at in memo:
            return memo[at]
        n = self.program.nodes[at]
        if isinstance(n, (Term, Phrase)):
            out: bool | None = False
        elif isinstance(n, (And, Or)):
            got = [self._without_leaves(c, memo) for c in n.children]
            stop = isinstance(n, Or)
            if not got:
                out = False
            elif stop in got:
                out = stop
            else:
                out = None if None in got else not stop
        elif isinstance(n, Not):
            inner = self._without_leaves(n.child, memo)
            out = None if inner is None else not inner
        else:
            inner = self._without_leaves(n.child, memo)
            out = False if inner is False else inner if isinstance(n, ConstantScore) else None
        memo[at] = out
        return out

    def _flat_or(self, root) -> bool:
        """Whether a node is an Or of unboosted terms, each once and in the order of the leaves."""
        if not isinstance(root, Or):
            return False
        below = [self.program.nodes[c] for c in root.children]
        if not all(isinstance(b, Term) and abs(b.boost - 1) <= FLOAT_EPSILON for b in below):
            return False
        return [self.leaf_of["term", b.field_id, b.term] for b in below] == list(range(len(self.leaf_of)))

    # -- plans --

    def compile(self) -> Compiled:
        leaves = self._leaves()
        root = self.program.nodes[self.program.root]
        filters = bool(self.attributes or self.used_slots)
        if isinstance(root, Term) and not filters:
            # one posting is one hit: nothing to group
            s = F.col("s")
            if abs(root.boost - 1) > FLOAT_EPSILON:
                s = saturate(s * F.lit(root.boost).cast(self.type))
            hits = leaves.select("doc_id", s.alias("score")) if self.scorer else leaves.select("doc_id")
            return Compiled(hits, leaves)
        n = len(self.leaf_of)
        grouped = leaves.groupBy("doc_id")
        if n > WIDE and not filters and self._flat_or(root):
            # any leaf is a match: no column or lookup for each. Doubles are finite and can't overflow as they are summed; floats are added in the order of the leaves
            if self.type == "double":
                s = saturate(F.sum("s"))
            else:
                adds = F.transform(F.array_sort(F.collect_list(F.struct("leaf", "s"))), lambda x: x["s"])
                s = F.aggregate(adds, F.lit(0.0).cast(self.type), lambda a, x: saturate(a + x).cast(self.type))
            s = saturate(s * F.lit(root.boost).cast(self.type)) if abs(root.boost - 1) > FLOAT_EPSILON else s
            return Compiled(grouped.agg(s.alias("score")) if self.scorer else leaves.select("doc_id").distinct(), leaves)
        if n <= WIDE:
            cells = [F.max(F.when(F.col("leaf") == i, F.col("s"))).alias(f"s__{i}") for i in range(n)]
            pivot = grouped.agg(*(cells or [F.count(F.lit(1)).alias("none__")]))
            matched = lambda i: F.col(f"s__{i}").isNotNull()
            scored = lambda i: F.col(f"s__{i}")
        else:
            pivot = grouped.agg(F.map_from_entries(F.collect_list(F.struct("leaf", "s"))).alias("m__"))
            matched = lambda i: F.coalesce(F.map_contains_key("m__", i), F.lit(False))
            scored = lambda i: F.try_element_at("m__", F.lit(i))
        base = pivot
        if self._without_leaves(self.program.root, {}) is not False:
            base = self._with_attributes(self.index.docs, True).join(pivot, "doc_id", "left")
        elif filters:
            base = self._with_attributes(pivot, False)
        m, s = self._fold(self.program.root, matched, scored, {})
        hits = base.where(m)
        zero = F.lit(0.0).cast(self.type)
        hits = hits.select("doc_id", F.coalesce(s, zero).alias("score")) if self.scorer else hits.select("doc_id")
        return Compiled(hits, leaves)

    def _with_attributes(self, base: DataFrame, whole: bool) -> DataFrame:
        docs = self.index.docs
        columns = [docs[a].alias(f"a__{a}") for a in sorted(self.attributes)]
        columns += [f.alias(f"slot__{s}") for s, f in self.used_slots.items() if isinstance(f, Column)]
        if whole:
            base = docs.select("doc_id", *columns)
        elif columns:
            base = base.join(docs.select("doc_id", *columns), "doc_id")
        for s, f in self.used_slots.items():
            if isinstance(f, DataFrame):
                base = base.join(f.select("doc_id").distinct().withColumn(f"slot__{s}", F.lit(True)), "doc_id", "left")
        return base
