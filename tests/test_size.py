"""Steps that larger tables were too much for: what they shuffle, and that their results hold on odd rows."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.functions import grouping
from quillon.functions.analysis import AnalyzerSpec, FieldAnalyzers, Token, WhitespaceTokenizer, terms
from quillon.functions.scoring import Bm25Scorer, ScoringStats
from quillon.operators import postings
from quillon.plans import ast
from quillon.sources import index as module
from quillon.sources.index import IndexBuilder


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_positions_are_grouped_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice(["a", "b", "c", ""]) for _ in range(rng.choice((0, 1, 2, 9)))]) for i in range(40)] + [(99, None)]
    schema = "doc_id long, terms array<string>"
    want = {(w, i, ws.count(w), tuple(k for k, x in enumerate(ws) if x == w)) for i, ws in rows for w in ws or ()}
    monkeypatch.setattr(grouping, "TOKENS", 20)  # several slices, in this process
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "terms": [r[1] for r in rows]}, pa.schema({"doc_id": pa.int64(), "terms": pa.list_(pa.string())}))
    made = list(grouping.positions(iter([batch])))
    assert len(made) > 1 and {(r["term"], r["doc_id"], r["tf"], tuple(r["positions"])) for b in made for r in b.to_pylist()} == want
    got = postings.with_positions(spark.createDataFrame(rows, schema))
    assert not {"Aggregate", "Generate"} & set(plan(got).replace("(", " ").split())
    assert {(r["term"], r["doc_id"], r["tf"], tuple(r["positions"])) for r in got.collect()} == want
    # an id that occurs again, and a null one, give one row for each term
    twice = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["a"]), (None, ["a"]), (None, ["a", "a"])], schema)
    got = {(r["term"], r["doc_id"], r["tf"], tuple(r["positions"])) for r in postings.with_positions(twice).collect()}
    assert got == {("a", 1, 2, (0, 0)), ("b", 1, 1, (1,)), ("a", 2, 1, (0,)), ("a", None, 3, (0, 0, 1))}


def test_texts_are_normalised_at_once(spark):
    spec, rng = AnalyzerSpec.default(), random.Random(6)
    texts = ["".join(rng.choice("aΣσ. \t\x1c\x1d\x85\xa0  　İÉéẛ̣ﬁ") for _ in range(rng.randrange(30))) for _ in range(300)]
    made = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(terms(F.col("t"), spec).alias("x"))
    want = [[spec.normalize(t.text) for t in WhitespaceTokenizer().tokenize(text)] for text in texts]
    assert [r["x"] for r in made.collect()] == [*want, None]


def test_an_index_is_built_of_lists(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["a", "A", "b", "é", f"x{rng.randrange(99)}"]) for _ in range(rng.choice((0, 1, 5, 40))))) for i in range(400)]
    want = {(w, i, t.lower().split().count(w), len(t.split())) for i, t in rows for w in set(t.lower().split())}
    index = IndexBuilder(FieldAnalyzers({1: AnalyzerSpec.default()})).from_dataframe(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", {1: "t"})
    assert not {"Aggregate", "Repartition"} & set(plan(index.postings).replace("(", " ").split())
    for name, n in (("FEW", 20), ("SAMPLED", 1500)):
        monkeypatch.setattr(module, name, n)
    monkeypatch.setattr(spark.conf, "get", lambda name, *rest, own=spark.conf.get: "9" if name == "spark.sql.shuffle.partitions" else own(name, *rest))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/lists"
    stale = IndexBuilder(FieldAnalyzers({2: AnalyzerSpec.default()})).from_dataframe(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", {2: "t"})
    stale.save(path)
    saved = index.save(path)  # over another index, of which nothing may stay
    assert [(r["term"], r["doc_id"], r["tf"], r["dl"]) for r in saved.postings.collect() if r["field_id"] != 1] == []
    assert sorted((r["term"], r["doc_id"], r["tf"], r["dl"]) for r in saved.postings.collect()) == sorted(want)
    assert {(r["term"], r["df"]) for r in saved.terms.collect()} == set(Counter(w[0] for w in want).items())
    files = saved.postings.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(files) > 5 and max(r["n"] for r in files) < len(want) / 2


def test_a_term_over_several_files():
    batch = pa.RecordBatch.from_pydict({"doc_id": range(3000), "field_id": [1] * 3000, "toks": ["a\nm\nz"] * 3000, "dl": [3] * 3000}, pa.schema({"doc_id": pa.int64(), "field_id": pa.int32(), "toks": pa.string(), "dl": pa.int32()}))
    parts = {}
    for b in grouping.posting_lists(iter([batch]), bounds=("b", "m", "m", "m", "x")):
        for r in b.to_pylist():
            parts.setdefault(r["term"], set()).add(r["part"])
            assert len(r["posts"]) <= grouping.POSTINGS
    assert parts == {"a": {0}, "m": {2, 3, 4}, "z": {5}}


def test_terms_with_breaks_and_repeated_fields(spark):
    class Commas:  # in here, so that workers get it by value
        def tokenize(self, text, position=0):
            return [Token(t, i, 0, 0) for i, t in enumerate(text.split(","))]

    spec = AnalyzerSpec((), Commas())
    rows = [(1, "a\nb,\\n,a,"), (2, ""), (3, "\\,b\n\\")]
    index = IndexBuilder(FieldAnalyzers({1: spec})).from_dataframe(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", {1: "t"})
    assert sorted((r["term"], r["doc_id"]) for r in index.postings.collect()) == sorted((w, i) for i, t in rows for w in set(t.split(",")))
    engine = Engine(index)
    assert [r["doc_id"] for r in engine.hits(engine.plan(ast.phrase(["a\nb", "\\n"]))).collect()] == [1]
    parts = spark.createDataFrame([(1, ["a", "", "b a"]), (2, [""]), (3, [None])], "doc_id long, t array<string>")
    index = IndexBuilder(FieldAnalyzers({1: AnalyzerSpec.default()})).from_dataframe(parts, "doc_id", {1: "t"})
    assert {(r["term"], r["doc_id"], r["tf"], r["dl"]) for r in index.postings.collect()} == {("a", 1, 2, 3), ("b", 1, 1, 3)}
    assert {(r["doc_id"], r["dl"]) for r in index.doc_lengths.collect()} == {(1, 3), (2, 0)}


def test_texts_without_all_words_are_not_split(spark):
    rows = [(1, "in x the"), (2, "the in"), (3, "inthe in"), (4, "in in x y the"), (5, "in x y z the")]
    engine = Engine(IndexBuilder(FieldAnalyzers({1: AnalyzerSpec.default()})).from_dataframe(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", {1: "t"}))
    found = engine.hits(engine.plan(ast.phrase_with_slop(["in", "the"], 2)))
    assert {r["doc_id"] for r in found.collect()} == {1, 4} and "Contains" in plan(found)


def test_wide_or_sums_without_lists(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(50)]
    index = IndexBuilder(FieldAnalyzers({1: AnalyzerSpec.default()})).from_dataframe(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", {1: "t"}).save(f"{spark.conf.get('spark.checkpoint.dir')}/wide")
    build = ast.QueryBuilder()
    build.or_([build.term(w) for w in words])
    one, exact = Engine(index), Engine(index, precision="float")
    hits = one.hits(one.plan(build.build()), Bm25Scorer())
    assert "collect_list" not in plan(hits)
    want = {}
    for r in index.postings.collect():
        stats = ScoringStats(r["tf"], r["dl"], index.avgdl(1), index.document_count, sum(r["term"] in t.split() for _, t in rows))
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + Bm25Scorer().value(stats)
    for got, near in ((hits, 1e-9), (exact.hits(exact.plan(build.build()), Bm25Scorer()), 1e-5)):
        got = {r["doc_id"]: r["score"] for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - s) < near for d, s in want.items())


def test_blocks_of_a_term_are_numbered_by_range(spark):
    rows = [(i * 7 % 500, "a " * (i % 5 + 1) + "b") for i in range(500)]
    index = IndexBuilder(FieldAnalyzers({1: AnalyzerSpec.default()})).from_dataframe(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", {1: "t"}).save(f"{spark.conf.get('spark.checkpoint.dir')}/blocks")
    own = index.blocked_of(index.postings.where("term = 'a'"))
    assert "range__" in plan(own)  # a term's rows are in as many tasks as it has ranges
    assert {(r["doc_id"], r["block_no"]) for r in own.collect()} == {(i, i // 2) for i in range(500)}
    engine = Engine(index)
    root = engine.plan("a").program.nodes[-1]
    got = [(r["doc_id"], r["score"]) for r in engine.block_max(root, 10).collect()]
    assert got == [(r["doc_id"], r["score"]) for r in engine.search("a", 10).collect()]
