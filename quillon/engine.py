"""The engine: plan, execute, search; and block-max top-k for single terms."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.errors import MissingScorer
from quillon.functions.scoring import Bm25Scorer, Scorer
from quillon.operators.collect import Collector, Hits, TopK, hit_order
from quillon.plans import ast
from quillon.plans.compiler import Compiler
from quillon.plans.filters import NO_FILTER, Slots
from quillon.plans.planner import Planner, PlanningContext, leaves, parse
from quillon.plans.program import ExecutionPlan, Term
from quillon.sources.index import Index


@dataclass(frozen=True)
class ExecutionStats:
    scored_postings: int = 0
    skipped_blocks: int = 0
    collected_hits: int = 0


class _Dictionary:
    """Terms of one query, looked up by one read."""

    def __init__(self, index: Index, wanted: list[tuple[int, str]]):
        self.index = index
        self.df = index.dictionary([(f, t) for f, text in wanted if (t := index.analyzed(f, text)) is not None])

    def resolve_term(self, field_id: int, text: str) -> str | None:
        term = self.index.analyzed(field_id, text)
        return term if term is not None and (field_id, term) in self.df else None


class Engine:
    def __init__(self, index: Index, planner: Planner = Planner(), precision: str = "double", strict: bool = False):
        self.index, self.planner, self.precision, self.strict = index, planner, precision, strict
        self.last_stats = ExecutionStats()

    def _context(self, found: list[tuple[str | None, str]]) -> PlanningContext:
        default = self.index.default_fields()
        wanted = []
        for name, text in found:
            f = self.index.resolve_field(name) if name is not None else None
            wanted += [(x, text) for x in ((f,) if f is not None else default if name is None else ())]
        return PlanningContext(self.index, _Dictionary(self.index, wanted), default)

    def plan(self, query: str | ast.UserProgram, filters: Slots = NO_FILTER) -> ExecutionPlan:
        """A plan of a query text or a built program, wrapped in the filters' slots."""
        if isinstance(query, str):
            plan = self.planner.plan(query, self._context(leaves(parse(query))))
        else:
            found: list[tuple[str | None, str]] = []
            for _, node in query.walk():
                if isinstance(node, ast.UserTerm):
                    found.append((node.field, node.term))
                elif isinstance(node, ast.UserPhrase):
                    found += [(node.field, t) for t in node.terms]
            plan = self.planner.plan_program(query, self._context(found))
        for slot in filters.slots():
            plan = plan.wrap_external_filter(slot)
        return plan

    def hits(self, plan: ExecutionPlan, scorer: Scorer | None = None, filters: Slots = NO_FILTER) -> DataFrame:
        """All hits, lazily: (doc_id, score), without score if no scorer is given."""
        return Compiler(self.index, plan, scorer, filters, self.strict, self.precision).compile().hits

    def execute(self, plan: ExecutionPlan, collector: Collector, scorer: Scorer | None = None, filters: Slots = NO_FILTER) -> Any:
        """Run a collector over the hits; last_stats then holds what was scored and collected."""
        if collector.needs_scores and scorer is None:
            raise MissingScorer()
        used = scorer if collector.needs_scores else None
        root = plan.program.nodes[plan.program.root]
        if isinstance(collector, TopK) and used and isinstance(root, Term) and root.boost >= 0 and collector.k and not filters.of:
            collector.rows, self.last_stats = self._block_max(root, collector.k, used)
            return collector.rows
        made = Compiler(self.index, plan, used, filters, self.strict, self.precision).compile()
        if isinstance(collector, Hits):
            return collector.collect(made.hits)
        collected = Observation()
        out = collector.collect(made.hits.observe(collected, F.count(F.lit(1)).alias("n")))
        n = collected.get["n"]
        self.last_stats = ExecutionStats(made.leaves.count() if used else 0, 0, n)
        return out

    def search(self, query: str | ast.UserProgram, k: int, scorer: Scorer = Bm25Scorer(), filters: Slots = NO_FILTER) -> DataFrame:
        """The k best hits, best first, as a DataFrame."""
        return TopK(k).transform(self.hits(self.plan(query, filters), scorer, filters))

    def count(self, query: str | ast.UserProgram, filters: Slots = NO_FILTER) -> DataFrame:
        return self.hits(self.plan(query, filters), None, filters).agg(F.count(F.lit(1)).alias("n"))

    # -- block-max --

    def _bounded(self, root: Term, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
        """Postings of a term with block numbers and scores, and its blocks with the most a posting in them can score."""
        index = self.index
        df = index.dictionary([(root.field_id, root.term)]).get((root.field_id, root.term), 0)
        of = lambda tf, dl: scorer.column(F.col(tf), F.col(dl), index.avgdl(root.field_id), index.document_count, df) * F.lit(float(root.boost))
        own = index.blocked_of(index.postings.where((F.col("field_id") == root.field_id) & (F.col("term") == root.term)))
        blocks = index.blocks_of(own).withColumn("bound", of("max_tf", "min_dl"))
        return own.withColumn("score", of("tf", "dl")), blocks

    def block_max(self, root: Term, k: int, scorer: Scorer = Bm25Scorer()) -> DataFrame:
        """Top-k of one term in two phases: k blocks of the best bounds hold k postings, the least of which is a threshold for all others."""
        rows, blocks = self._bounded(root, scorer)
        best = blocks.orderBy(F.desc("bound"), "block_no").limit(k).select("block_no")
        threshold = rows.join(best, "block_no", "left_semi").select("doc_id", "score").orderBy(*hit_order()).limit(k).agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("least"))
        limit = threshold.select(F.when(F.col("held") >= k, F.col("least")).alias("least"))
        live = blocks.crossJoin(F.broadcast(limit)).where("least is null or bound >= least").select("block_no")
        return TopK(k).transform(rows.join(live, "block_no", "left_semi"))

    def _block_max(self, root: Term, k: int, scorer: Scorer) -> tuple[list, ExecutionStats]:
        rows, blocks = self._bounded(root, scorer)
        best = blocks.orderBy(F.desc("bound"), "block_no").limit(k).select("block_no")
        first = rows.join(best, "block_no", "left_semi").select("doc_id", "score").orderBy(*hit_order()).limit(k).collect()
        least = first[-1]["score"] if len(first) == k else float("-inf")
        live = blocks.where(F.col("bound") >= F.lit(least))
        out = TopK(k).transform(rows.join(live.select("block_no"), "block_no", "left_semi")).collect()
        total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("bound") < F.lit(least)).cast("int")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("bound") >= F.lit(least), F.col("n_postings"))), F.lit(0))).first()
        return out, ExecutionStats(total[2], total[1], total[2])
