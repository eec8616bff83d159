"""Behaviour of search on small corpora, and a random comparison with set algebra."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon import errors
from quillon.engine import Engine
from quillon.functions.analysis import AnalyzerSpec, FieldAnalyzers, NormalizerSpec, WhitespaceTokenizer
from quillon.functions.scoring import Bm25FScorer, Bm25Params, Bm25Scorer, CombinedScorer, FieldStats, ScoringStats
from quillon.operators import fusion
from quillon.operators.collect import Count, Group, TopK
from quillon.plans import ast
from quillon.plans.filters import Eq, Slots
from quillon.plans.planner import Planner, PlanningContext, parse
from quillon.plans.program import And, ConstantScore, ExecutionPlan, Filter, Not, Or, Program, Term
from quillon.sources.index import Index, IndexBuilder
from quillon.sources.segment import SegmentView, export


def build(spark, rows, spec=AnalyzerSpec.default(), fields=("text",), block_size=2):
    schema = "doc_id long, " + ", ".join(f"{f} string" for f in fields)
    df = spark.createDataFrame([(r[0], *r[1:]) for r in rows], schema)
    b = IndexBuilder(FieldAnalyzers({i + 1: spec for i in range(len(fields))}), block_size)
    for i, f in enumerate(fields):
        b.register_field_alias(i + 1, f)
    return b.from_dataframe(df, "doc_id", {i + 1: f for i, f in enumerate(fields)})


def ids(df):
    return {r["doc_id"] for r in df.collect()}


def matches(index, text):
    e = Engine(index)
    return ids(e.hits(e.plan(text)))


def test_boolean_scores(spark):
    e = Engine(build(spark, [(1, "alpha"), (2, "alpha beta"), (3, "gamma")]))
    got = {r["doc_id"]: r["score"] for r in e.search("alpha OR NOT beta", 10).collect()}
    assert got[3] == 0 and got[1] > 0 and got[2] > 0
    assert {r["doc_id"]: r["score"] for r in e.search("NOT beta", 10).collect()} == {1: 0.0, 3: 0.0}
    assert ids(e.search("alpha AND NOT beta", 5)) == {1}
    p = e.plan("alpha OR NOT beta").program
    constant = ExecutionPlan.of(Program((*p.nodes, ConstantScore(p.root, 2.25)), len(p.nodes)))
    assert {r["score"] for r in e.hits(constant, Bm25Scorer()).collect()} == {2.25}
    assert ids(e.search("missing AND alpha", 5)) == set()


def test_known_scores(spark):
    docs = [(1, "Rust Programming", "Rust is a systems programming language"), (2, "Information Retrieval", "Search engines use inverted indices for retrieval"), (3, "Cooking Notes", "Recipes and ingredients")]
    e = Engine(build(spark, docs, fields=("title", "body")))
    for scorer in (Bm25Scorer(), Bm25FScorer()):
        got = [(r["doc_id"], round(r["score"], 6)) for r in e.search("title:rust OR body:retrieval", 10, scorer).collect()]
        assert got == [(1, 0.980829), (2, 0.869652)]
    stats = ScoringStats(2, 100, 150, 1000, 50)
    assert Bm25Scorer().value(stats) == pytest.approx(4.531669, abs=1.5e-6)
    assert Bm25Scorer(Bm25Params(2.0, 0.5)).value(ScoringStats(3, 100, 150, 1000, 50)) == pytest.approx(5.760222, abs=1.5e-6)
    two = ScoringStats(0, 0, 150, 1000, 50, (FieldStats(1, 2, 50, 2.0), FieldStats(2, 1, 100, 1.0)))
    assert Bm25FScorer().value(two) == pytest.approx(5.054554, abs=1.5e-6)
    assert Bm25Scorer().score(ScoringStats(0, 1, 1, 1, 1)) is None and Bm25Scorer().value(ScoringStats(1, 1, math.nan, 9, 1)) == 0
    assert CombinedScorer(Bm25Scorer(), Bm25FScorer(), 2.0).score(stats) == pytest.approx(2 * 4.531669, abs=1e-5)


def test_ties_counts_and_pruning(spark):
    e = Engine(build(spark, [(1, "alpha"), (10, "alpha")]))
    assert [r["doc_id"] for r in e.execute(e.plan("alpha"), TopK(1), Bm25Scorer())] == [10]
    rows = [(1, "alpha " * 4), (2, "alpha " * 3), (3, "alpha" + " noise" * 9), (4, "alpha" + " noise" * 11)]
    e = Engine(build(spark, rows))
    assert [r["doc_id"] for r in e.execute(e.plan("alpha"), TopK(1), Bm25Scorer())] == [1]
    assert e.last_stats.scored_postings < 4 and e.last_stats.skipped_blocks > 0
    top, n = e.execute(e.plan("alpha"), Group(TopK(1), Count()), Bm25Scorer())
    assert n == 4 and len(top) == 1 and e.last_stats.scored_postings == 4
    assert e.execute(e.plan("alpha"), Count()) == 4 and e.last_stats.scored_postings == 0
    with pytest.raises(errors.MissingScorer):
        e.execute(e.plan("alpha"), TopK(1))
    assert e.execute(e.plan("alpha"), TopK(0), Bm25Scorer()) == []
    assert e.execute(e.plan("missing"), TopK(2), Bm25Scorer()) == [] and e.last_stats.collected_hits == 0
    assert e.execute(e.plan("missing OR NOT alpha"), Count()) == 0


def test_random_boolean(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma"]
    rows = [(i, " ".join(w for w in words if rng.random() < 0.5)) for i in range(23)]
    index = build(spark, rows).save(f"{spark.conf.get('spark.checkpoint.dir')}/idx")
    has = {w: {i for i, t in rows if w in t.split()} for w in words}
    every = {i for i, _ in rows}
    assert matches(index, "alpha AND NOT beta") == has["alpha"] - has["beta"]
    assert matches(index, "alpha beta OR NOT gamma") == (has["alpha"] & has["beta"]) | (every - has["gamma"])
    assert matches(index, "NOT NOT alpha") == has["alpha"]
    wide = Engine(index)
    b = ast.QueryBuilder()
    b.or_([b.term(w) for w in [*(f"x{i}" for i in range(40)), *words]])
    assert ids(wide.hits(wide.plan(b.build()), Bm25Scorer())) == has["alpha"] | has["beta"] | has["gamma"]
    assert Index.open(spark, f"{spark.conf.get('spark.checkpoint.dir')}/idx").document_count == 23


def test_unicode(spark):
    assert matches(build(spark, [(1, "CAFÉ"), (2, "café"), (3, "ΣΠΊΤΙ")]), "café") == {1, 2}
    assert matches(build(spark, [(1, "ΟΣ")]), "ος") == {1}
    fold = AnalyzerSpec((NormalizerSpec("NFC", "fold"),))
    assert matches(build(spark, [(1, "Straße")], fold), "STRASSE") == {1}
    toks = WhitespaceTokenizer().tokenize("é b c")
    assert [(t.text, t.start, t.end) for t in toks] == [("é", 0, 2), ("b", 4, 5), ("c", 8, 9)]


def test_phrases(spark):
    e = Engine(build(spark, [(1, "a b c"), (2, "a x b"), (3, "b a"), (4, "")]))
    assert ids(e.hits(e.plan(ast.phrase(["a", "b"])))) == {1}
    assert ids(e.hits(e.plan(ast.phrase_with_slop(["a", "b"], 1)))) == {1, 2}


def test_empty_and_supplied_fields(spark):
    index = build(spark, [(1, None), (2, ""), (3, "a")])
    assert index.stats == {1: (2, 1)} and index.document_count == 3
    none = build(spark, [])
    assert none.document_count == 0 and matches(none, "NOT a") == set()
    with pytest.raises(errors.DuplicateDocument):
        build(spark, [(1, "a"), (1, "b")])
    with pytest.raises(errors.MissingAnalyzer):
        IndexBuilder(FieldAnalyzers()).from_dataframe(spark.createDataFrame([(1, "a")], "doc_id long, t string"), "doc_id", {1: "t"})


def test_filters(spark):
    e = Engine(build(spark, [(1, "rust search engine"), (2, "rust programming"), (3, "search algorithms")]))
    only = lambda *x: F.col("doc_id").isin(list(x))
    assert ids(e.search("rust", 9, filters=Slots({1: only(1, 2), 2: only(2, 3)}))) == {2}
    assert ids(e.search("rust", 9, filters=Slots({1: F.lit(False)}))) == set()
    p = e.plan("rust").program
    structured = ExecutionPlan.of(Program((*p.nodes, Filter(p.root, Eq("doc_id", 1))), len(p.nodes)))
    assert ids(e.hits(structured)) == {1}
    with pytest.raises(errors.UnsupportedFilterPredicate):
        Engine(e.index, strict=True).hits(structured)


@pytest.mark.parametrize("text,tree", [
    ("a b", ("and", (("term", None, "a"), ("term", None, "b")))),
    ("a OR b AND c", ("or", (("term", None, "a"), ("and", (("term", None, "b"), ("term", None, "c")))))),
    ("NOT NOT a", ("not", (("not", (("term", None, "a"),)),))),
    ("title:a:b", ("term", "title", "a:b")),
    ("a\tAND\tb", ("and", (("term", None, "a"), ("term", None, "AND"), ("term", None, "b")))),
])
def test_parse(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "   ", "title:", "title:new york", "a OR  OR b"])
def test_parse_errors(text):
    with pytest.raises(errors.ParseError):
        parse(text)


class Stub:
    known = {(1, "rust"), (2, "rust"), (2, "memory")}

    def resolve_field(self, name):
        return {"title": 1, "body": 2}.get(name)

    def resolve_term(self, field, text):
        return text.strip() if (field, text.strip()) in self.known else None


def test_planner():
    c = PlanningContext(Stub(), Stub(), (2,))
    p = Planner().plan("title:rust AND body:memory", c)
    assert (p.cost, p.program.depth) == (3, 2)
    assert Planner().plan("body:unknown", c).program.nodes == (And(()),)
    both = PlanningContext(Stub(), Stub(), (1, 2))
    assert isinstance(Planner().plan("rust", both).program.nodes[-1], Or)
    assert Planner().plan("memory", both).program.nodes == (Term(2, "memory"),)
    with pytest.raises(errors.UnknownField):
        Planner().plan("summary:rust", c)
    with pytest.raises(errors.MaxDepthExceeded):
        Planner(max_depth=1).plan("rust AND memory", c)
    wrapped = p.wrap_external_filter(1).wrap_external_filter(2)
    assert (wrapped.cost, wrapped.program.depth, wrapped.selectivity) == (5, 4, 1 / 5)


def test_programs():
    with pytest.raises(errors.ProgramCycle):
        Program((Not(0),), 0)
    with pytest.raises(errors.UnreachableProgramNode):
        Program((Term(1, "a"), Term(1, "b")), 0)
    with pytest.raises(errors.InvalidProgramReference):
        Program((Not(4),), 0)
    b = ast.QueryBuilder()
    root = b.and_([b.term("a"), b.boost(b.term_with_field("b", "f"), 2.0)])
    program = b.build()
    assert program.root == root and len(list(program.walk())) == 4 and ast.QueryBuilder().build() is None
    with pytest.raises(errors.WrongNodeType):
        program.as_phrase(root)


def test_fusion(spark):
    make = lambda *lists: fusion.ranked(spark, [[fusion.RankedResult(x, i + 1) for i, x in enumerate(r)] for r in lists])
    got = [(r["id"], r["score"], r["rank"]) for r in fusion.fuse(make("abg", "bda")).orderBy("rank").collect()]
    assert [g[0] for g in got][:2] == ["b", "a"] and [g[2] for g in got] == [1, 2, 3, 4]
    assert got[0][1] == pytest.approx(1 / 61 + 1 / 62, abs=1e-12)
    with pytest.raises(ValueError):
        fusion.FusionConfig(0.0)


def test_segment(spark):
    data = export(build(spark, [(1, "Rust Retrieval")]))
    view = SegmentView.open(data)
    assert (len(data), view.document_count, view.term_count, view.field_count) == (189, 1, 2, 1)
    for bad, kind in ((b"short", errors.TruncatedHeader), (bytes(24), errors.InvalidMagic), (data[:28] + (5).to_bytes(4, "little") + data[32:], errors.OutOfBoundsSection)):
        with pytest.raises(kind):
            SegmentView.open(bad)
