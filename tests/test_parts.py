"""Small parts of the engine: analysis helpers, scores, hits, postings, segments, limits, streams."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from quillon import errors
from quillon.engine import Engine
from quillon.functions import scoring
from quillon.functions.analysis import MAX_FIELDS, AnalyzerSpec, FieldAnalyzers, NormalizerSpec, normalized, offset_tokens, terms
from quillon.operators import fusion, postings
from quillon.operators.collect import Group, ScoredHit, TopK
from quillon.plans import ast
from quillon.plans.planner import Planner, PlanningContext
from quillon.plans.program import ExecutionPlan, FeatureSet, Program, Term
from quillon.sources import segment
from quillon.sources.index import Index, IndexBuilder
from quillon.streaming.analysis import analyzed_stream


def build(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return IndexBuilder(FieldAnalyzers({1: AnalyzerSpec.default()})).register_field_alias(1, "text").from_dataframe(df, "doc_id", {1: "text"})


def test_scores():
    assert (scoring.ZERO, scoring.ONE, scoring.MIN, scoring.MAX) == (0.0, 1.0, -scoring.FLOAT_MAX, scoring.FLOAT_MAX)
    assert scoring.added(scoring.MAX, scoring.MAX) == scoring.MAX and scoring.subtracted(scoring.MIN, scoring.MAX) == scoring.MIN
    assert scoring.subtracted(3.0, 1.0) == 2.0 and scoring.saturated(math.nan) == 0
    for bad in (math.nan, math.inf, -math.inf):
        with pytest.raises(errors.NonFiniteScore):
            scoring.score(bad)
    for k1, b in ((-1, 0.5), (math.inf, 0.5), (1, 1.5), (1, math.nan)):
        with pytest.raises(ValueError):
            scoring.Bm25Params(k1, b)
    one = scoring.CombinedScorer(scoring.Bm25Scorer(), scoring.Bm25FScorer(), 2.0)
    stats = scoring.ScoringStats(2, 100, 150, 1000, 50)
    assert one.score(stats) == pytest.approx(2 * scoring.Bm25Scorer().value(stats))


def test_hits_and_thresholds(spark):
    hits = [ScoredHit(1, 0.5), ScoredHit.perfect(2), ScoredHit.zero(3), ScoredHit(4, 0.5)]
    assert [h.doc_id for h in sorted(hits, reverse=True)] == [2, 4, 1, 3] and hits[2].is_zero and not hits[1].is_zero
    rows = spark.createDataFrame([(h.doc_id, h.score) for h in hits], "doc_id long, score double")
    top = TopK(2)
    assert top.min_score is None and not top.can_skip(0.0) and len(top) == 0
    assert [r["doc_id"] for r in top.collect(rows)] == [2, 4] and len(top) == 2
    assert top.min_score == 0.5 and top.can_skip(0.4) and not top.can_skip(0.5)
    assert TopK(0).min_score == scoring.FLOAT_MAX and TopK(0).can_skip(1.0)
    both = Group(TopK(1), TopK(3))
    assert both.min_score is None
    both.collect(rows)
    assert both.min_score == 0.5 and both.needs_scores and not both.requires_exhaustive_matches
    assert fusion.RankedResult("a", 1).rank == 1
    with pytest.raises(ValueError):
        fusion.RankedResult("a", 0)


def test_blocks(spark):
    rows = spark.createDataFrame([("a", i * 10, i % 4) for i in range(1, 6)], "term string, doc_id long, tf int")
    states = postings.block_states(rows, 2)
    at = lambda x: postings.current_block(states, "a", x)
    assert at(5) == postings.CurrentBlock(postings.BlockState.READY, 20, 2) and at(21).end_doc == 40
    assert at(51).state == at(None).state == postings.current_block(states, "b", 1).state == postings.BlockState.EXHAUSTED
    assert postings.current_block(None, "a", 1).state == postings.BlockState.UNSUPPORTED
    made = postings.lists(rows).first()
    assert made["n"] == 5 and [p["doc_id"] for p in made["postings"]] == [10, 20, 30, 40, 50]
    found = postings.cursor(rows, "a", 25)
    assert [r["doc_id"] for r in found.collect()] == [30, 40, 50]
    assert rows.select(postings.term_freq(F.lit(None).cast("int")).alias("n")).first()["n"] == 0


def test_analysis_columns(spark):
    spec = NormalizerSpec()
    assert spec.needs_canonical_form("é") and not spec.needs_canonical_form("é") and spec.needs_case_mapping("A") and spec.needs_normalize("A") and not spec.needs_normalize("a")
    df = spark.createDataFrame([("É b c",), (None,), ("",)], "t string")
    got = [r["x"] for r in df.select(offset_tokens("t", AnalyzerSpec.default()).alias("x")).collect()]
    assert [(t["text"], t["position"], t["start"], t["end"]) for t in got[0]] == [("é", 0, 0, 2), ("b", 1, 3, 4), ("c", 2, 7, 8)] and got[1:] == [None, []]
    assert [r["x"] for r in df.select(normalized("t", NormalizerSpec("NFKC", "fold")).alias("x")).collect()] == ["é b c", None, ""]
    wide = AnalyzerSpec((NormalizerSpec("NFKC", "lower"),))
    assert spark.createDataFrame([("ﬁn Ａ",)], "t string").select(terms(F.col("t"), wide).alias("x")).first()["x"] == ["fin", "a"]
    with pytest.raises(ValueError):
        FieldAnalyzers({MAX_FIELDS: AnalyzerSpec.default()})
    with pytest.raises(ValueError):
        NormalizerSpec("NFD")


def test_segments(spark):
    index = build(spark, [(1, "rust search rust"), (2, "search"), (3, "")])
    data = segment.export(index)
    view = segment.SegmentView.open(data)
    words, fields, lists = segment.decode(view)
    ids = {t: i for i, _, t in words}
    assert set(ids) == {"rust", "search"} and fields == [(1, 3, 4)]
    assert dict(lists) == {ids["rust"]: [(1, 2)], ids["search"]: [(1, 1), (2, 1)]}
    assert index.term_texts(ids.values()) == {i: (1, t) for t, i in ids.items()} and index.term_texts([99]) == {}

    def entry(i, **change):
        at = segment.HEADER.size + segment.ENTRY.size * i
        kind, offset, size = segment.ENTRY.unpack_from(data, at)
        return data[:at] + segment.ENTRY.pack(change.get("kind", kind), change.get("offset", offset), change.get("size", size)) + data[at + segment.ENTRY.size :]

    first = segment.ENTRY.unpack_from(data, segment.HEADER.size)
    fewer = data[: segment.HEADER.size - 4] + struct.pack("<I", 3) + data[segment.HEADER.size :]
    cases = [
        (data[:10], errors.TruncatedHeader), (b"XXXX" + data[4:], errors.InvalidMagic), (data[:4] + b"\x09\x00" + data[6:], errors.UnsupportedVersion), (data[:40], errors.TruncatedDirectory),
        (entry(1, kind=77), errors.UnknownSection), (entry(1, kind=first[0]), errors.DuplicateSection), (entry(1, size=1 << 20), errors.OutOfBoundsSection), (fewer, errors.MissingSection),
        (entry(1, offset=first[1]), errors.OverlappingSections),
    ]
    for bad, kind in cases:
        with pytest.raises(kind):
            segment.SegmentView.open(bad)
    with pytest.raises(errors.ValueOutOfRange):
        segment.encode(1 << 40, [], [], [])


class Nothing:
    def resolve_field(self, name):
        return None

    def resolve_term(self, field, text):
        return None


def test_limits_and_builders():
    with pytest.raises(errors.ParseError):
        Planner().plan("bare", PlanningContext(Nothing(), Nothing(), ()))
    with pytest.raises(errors.MaxNodesExceeded):
        Planner().with_max_nodes(2).plan("a b c", PlanningContext(Nothing(), Nothing(), (1,)))
    with pytest.raises(errors.InvalidProgramRoot):
        Program((Term(1, "a"),), 3)
    b = ast.QueryBuilder()
    b.set_root(b.not_(b.term("a")))
    program = b.build()
    assert program.as_boolean(program.root).op == "not"
    with pytest.raises(errors.InvalidNodeId):
        program.as_term(9)
    assert FeatureSet.basic() == FeatureSet(term_frequencies=True) == ExecutionPlan.of(Program((Term(1, "a"),), 0)).required_features

    class One(Nothing):
        def resolve_term(self, field, text):
            return text

    plan = Planner().plan("a", PlanningContext(One(), One(), (1,), 2.5))
    assert plan.program.nodes[plan.program.root].boost == 2.5


def test_phrases_of_an_index_that_was_opened_again(spark):
    rows = [(1, "a b c a b"), (2, "a x b"), (3, "b a"), (4, ""), (5, "a y z b a"), (6, None), (7, "a a b")]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/phrases"
    build(spark, rows).save(path)
    e = Engine(Index.open(spark, path))
    for slop in range(4):
        want = set()
        for i, text in rows:
            t = (text or "").split()
            if any(t[p] == "a" and t[q] == "b" and 0 <= q - p - 1 <= slop for p in range(len(t)) for q in range(p + 1, len(t))):
                want.add(i)
        assert {r["doc_id"] for r in e.hits(e.plan(ast.phrase_with_slop(["a", "b"], slop))).collect()} == want
    assert {r["doc_id"] for r in e.hits(e.plan(ast.phrase(["a", "b", "c"]))).collect()} == {1}


def test_stream(spark, tmp_path):
    place, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "A b"), (2, "")], "i long, t string")
    df.write.parquet(place)
    stream = analyzed_stream(spark.readStream.schema(df.schema).parquet(place), "i", "t", AnalyzerSpec.default())
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 0, "a"), (1, 1, "b")]
