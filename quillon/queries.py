"""The retrieval queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.functions.analysis import AnalyzerSpec, FieldAnalyzers, terms, tokens
from quillon.functions import scoring
from quillon.functions.scoring import Bm25FScorer, Bm25Params, Bm25Scorer, CombinedScorer, bm25f_column
from quillon.operators import facets, fusion, postings
from quillon.operators.collect import topk_with_count
from quillon.plans import ast
from quillon.plans.filters import AllOf, AnyOf, Eq, In, NotP, Predicate, Range, Slots
from quillon.plans.program import ConstantScore, ExecutionPlan, ExternalFilter, Filter, Program
from quillon.sources.index import Index, IndexBuilder
from quillon.sources.segment import SegmentView, export
from quillon.storage import shared_path

_BUILT: dict[tuple, Index] = {}
WIDE_TERMS = 500


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _new(spark: SparkSession, sf_dir: str, corpus: str) -> Index:
    if corpus == "documents":
        builder = IndexBuilder(FieldAnalyzers({1: AnalyzerSpec.default()})).register_field_alias(1, "text")
        return builder.from_dataframe(_read(spark, sf_dir, "documents"), "doc_id", {1: "text"}, ["lang", "source", "n_chars"])
    if corpus == "part":
        both = FieldAnalyzers({1: AnalyzerSpec.default(), 2: AnalyzerSpec.default()})
        builder = IndexBuilder(both).register_field_alias(1, "name").register_field_alias(2, "type")
        return builder.from_dataframe(_read(spark, sf_dir, "part"), "p_partkey", {1: "p_name", 2: "p_type"})
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))
    return IndexBuilder(FieldAnalyzers({1: AnalyzerSpec.default()})).from_dataframe(turns, "conv_id", {1: "texts"})


def index_of(spark: SparkSession, sf_dir: str, corpus: str = "documents") -> Index:
    """A corpus' index: built and stored once a session and folder, opened by every query after that."""
    key = (spark.sparkContext.applicationId, sf_dir, corpus)
    if key not in _BUILT:
        _BUILT[key] = _new(spark, sf_dir, corpus).save(shared_path(spark, f"index_{corpus}"))
    return _BUILT[key]


def forget(spark: SparkSession, sf_dir: str, corpus: str = "documents") -> None:
    """Have the next query build the corpus' index again."""
    _BUILT.pop((spark.sparkContext.applicationId, sf_dir, corpus), None)


# ---- SQL ----

SPACE = r"[\t-\r \x{85}\p{Z}]+"


def _cte(table: str, id_col: str, fields: dict[int, str], k1: float = 1.2, b: float = 0.75) -> str:
    """tok, dl, st, n, p, f and scores sc of a corpus, as in the tables of an index."""
    src = " UNION ALL ".join(f"SELECT {id_col} AS doc_id, {f} AS field_id, {c} AS text FROM {table} WHERE {c} IS NOT NULL" for f, c in fields.items())
    return f"""WITH src AS ({src}),
      tok AS (SELECT * FROM (SELECT doc_id, field_id, unnest(regexp_split_to_array(lower(nfc_normalize(text)), '{SPACE}')) AS term FROM src) WHERE term <> ''),
      c AS (SELECT doc_id, field_id, count(*) AS n FROM tok GROUP BY ALL),
      dl AS (SELECT s.doc_id, s.field_id, CAST(coalesce(c.n, 0) AS INTEGER) AS dl FROM src s LEFT JOIN c ON s.doc_id = c.doc_id AND s.field_id = c.field_id),
      st AS (SELECT field_id, count(*) AS doc_count, CAST(sum(dl) AS BIGINT) AS total_terms FROM dl GROUP BY field_id),
      docs AS (SELECT DISTINCT {id_col} AS doc_id FROM {table}), n AS (SELECT count(*) AS n FROM docs),
      p AS (SELECT t.field_id, t.term, t.doc_id, CAST(count(*) AS INTEGER) AS tf, any_value(dl.dl) AS dl FROM tok t JOIN dl ON t.doc_id = dl.doc_id AND t.field_id = dl.field_id GROUP BY t.field_id, t.term, t.doc_id),
      f AS (SELECT field_id, term, count(*) AS df FROM p GROUP BY field_id, term),
      sc AS (SELECT p.*, ln((n.n - f.df + 0.5) / (f.df + 0.5) + 1) * {k1 + 1} * p.tf
               / (p.tf + {k1} * ({1 - b} + {b} * p.dl / (CAST(st.total_terms AS DOUBLE) / st.doc_count))) AS s
             FROM p JOIN f ON p.field_id = f.field_id AND p.term = f.term JOIN st ON p.field_id = st.field_id, n)
    """


DOCS = _cte("documents", "doc_id", {1: "text"})
PART = _cte("part", "p_partkey", {1: "p_name", 2: "p_type"})
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def _top(where: str, k: int, cte: str = DOCS) -> str:
    return f"{cte} SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, sum(s) AS s FROM sc WHERE {where} GROUP BY doc_id) ORDER BY s DESC, doc_id DESC LIMIT {k}"


def _has(term: str, table: str = "p") -> str:
    return f"SELECT doc_id FROM {table} WHERE term = '{term}'"


def _matches(spark: SparkSession, sf_dir: str, text: str, corpus: str = "documents") -> DataFrame:
    engine = Engine(index_of(spark, sf_dir, corpus))
    return engine.hits(engine.plan(text))


# ---- analysis and index tables ----


@query(f"SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS position, unnest(l) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS l FROM documents)")
def tokenize_positions(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens("text")).alias("position", "term"))


@query(f"{DOCS} SELECT term, count(*) AS n FROM tok GROUP BY term")
def normalize_terms(spark, sf_dir):
    toks = _read(spark, sf_dir, "documents").select(F.explode(terms(F.col("text"), AnalyzerSpec.default())).alias("term"))
    return toks.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"{DOCS} SELECT field_id, term, df FROM f")
def term_dictionary(spark, sf_dir):
    return index_of(spark, sf_dir).terms


@query(f"{PART} SELECT field_id, term, df FROM f")
def document_frequency(spark, sf_dir):
    return index_of(spark, sf_dir, "part").terms.select("field_id", "term", "df")


@query(f"{DOCS} SELECT term, CAST(row_number() OVER (ORDER BY first_doc, term) - 1 AS BIGINT) AS term_id FROM (SELECT term, min(doc_id) AS first_doc FROM p GROUP BY term)")
def term_ids(spark, sf_dir):
    return index_of(spark, sf_dir).term_ids().select("term", "term_id")


@query(f"{DOCS} SELECT term, doc_id, tf, dl FROM p")
def postings_build(spark, sf_dir):
    return _new(spark, sf_dir, "documents").postings.select("term", "doc_id", "tf", "dl")


@query(_cte("(SELECT conv_id, string_agg(text, ' ') AS text FROM conversations GROUP BY conv_id)", "conv_id", {1: "text"}) + "SELECT term, doc_id, tf, dl FROM p")
def postings_repeated_field(spark, sf_dir):
    return index_of(spark, sf_dir, "conversations").postings.select("term", "doc_id", "tf", "dl")


@query(f"{DOCS} SELECT doc_id, field_id, dl FROM dl")
def doc_lengths(spark, sf_dir):
    return index_of(spark, sf_dir).doc_lengths


@query(f"{PART} SELECT field_id, doc_count, total_terms FROM st")
def field_stats(spark, sf_dir):
    return index_of(spark, sf_dir, "part").field_stats


@query(f"{PART} SELECT field_id, term, block_no, max(doc_id) AS end_doc, max(tf) AS max_tf, min(dl) AS min_dl, count(*) AS n_postings FROM (SELECT *, CAST((row_number() OVER (PARTITION BY field_id, term ORDER BY doc_id) - 1) // 2 AS BIGINT) AS block_no FROM p) GROUP BY field_id, term, block_no")
def posting_blocks(spark, sf_dir):
    return index_of(spark, sf_dir, "part").blocks


@query(f"{DOCS} SELECT t.term, t.target, coalesce(min(p.doc_id), -1) AS doc_id FROM (VALUES ('the', 100), ('and', 7), ('the', 99999999999)) t(term, target) LEFT JOIN p ON p.term = t.term AND p.doc_id >= t.target GROUP BY t.term, t.target")
def postings_seek(spark, sf_dir):
    targets = spark.createDataFrame([("the", 100), ("and", 7), ("the", 99999999999)], "term string, target long")
    return postings.seek_first(index_of(spark, sf_dir).postings, targets).na.fill(-1, ["doc_id"])


PLACED = f"SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '{SPACE}'), lambda x: x <> '') AS l FROM documents)"


@query(f"SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM ({PLACED}) GROUP BY term, doc_id")
def postings_with_positions(spark, sf_dir):
    toks = _read(spark, sf_dir, "documents").select("doc_id", terms(F.col("text"), AnalyzerSpec.default()).alias("terms"))
    return postings.with_positions(toks).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"{DOCS} SELECT term, count(*) AS n, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM p WHERE term IN ('the', 'aich', 'in') GROUP BY term")
def postings_lists(spark, sf_dir):
    some = index_of(spark, sf_dir).postings.where(F.col("term").isin("the", "aich", "in")).select("term", "doc_id", "tf")
    made = postings.lists(some)
    return made.select("term", F.col("n").cast("long").alias("n"), F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x.doc_id, x.tf)), ",").alias("postings"))


@query(f"{DOCS} SELECT doc_id, tf FROM p WHERE term = 'the' AND doc_id >= 300")
def term_cursor(spark, sf_dir):
    found = postings.cursor(index_of(spark, sf_dir).postings, "the", 300)
    return found.select("doc_id", postings.term_freq(F.col("tf")).alias("tf"))


@query(f"{DOCS} SELECT term, CAST(b AS BIGINT) AS block_no, max(doc_id) AS end_doc, max(tf) AS max_term_freq FROM (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 3 AS b FROM p WHERE term IN ('the', 'aich')) GROUP BY term, b")
def block_states(spark, sf_dir):
    some = index_of(spark, sf_dir).postings.where(F.col("term").isin("the", "aich"))
    return postings.block_states(some, 3).withColumn("block_no", F.col("block_no").cast("long"))


@query(f"{DOCS} SELECT doc_id, printf('%.4f', s) AS score FROM sc WHERE term = 'aich'")
def score_text(spark, sf_dir):
    engine = Engine(index_of(spark, sf_dir))
    return engine.hits(engine.plan("aich"), Bm25Scorer()).select("doc_id", scoring.score_text(F.col("score")).alias("score"))


@query("SELECT o_custkey AS doc_id, o_orderstatus AS term, arg_max(o_orderkey % 7, o_orderkey) AS tf FROM orders GROUP BY o_custkey, o_orderstatus")
def postings_upsert(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("term"), F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 7).alias("tf"), F.col("o_orderkey").alias("seq"))
    return postings.upsert(rows).select("doc_id", "term", "tf")


@query(f"{PART} SELECT n.n AS document_count, (SELECT count(*) FROM f) AS term_count, (SELECT count(*) FROM st) AS field_count FROM n")
def segment_counts(spark, sf_dir):
    view = SegmentView.open(export(index_of(spark, sf_dir, "part")))
    return spark.createDataFrame([(view.document_count, view.term_count, view.field_count)], "document_count long, term_count long, field_count long")


# ---- matching ----


@query(f"{DOCS} {_has('the')}")
def term_match(spark, sf_dir):
    return _matches(spark, sf_dir, "the")


@query(f"{DOCS} SELECT count(*) AS n FROM p WHERE term = 'the'")
def term_count(spark, sf_dir):
    return Engine(index_of(spark, sf_dir)).count("the")


@query(f"{DOCS} {_has('the')} UNION {_has('aich')}")
def bool_or(spark, sf_dir):
    return _matches(spark, sf_dir, "the OR aich")


@query(f"{DOCS} {_has('the')} INTERSECT {_has('in')}")
def bool_and(spark, sf_dir):
    return _matches(spark, sf_dir, "the AND in")


@query(f"{DOCS} SELECT doc_id FROM docs EXCEPT {_has('the')}")
def bool_not(spark, sf_dir):
    return _matches(spark, sf_dir, "NOT the")


@query(f"{DOCS} {_has('in')} EXCEPT {_has('the')}")
def bool_and_not(spark, sf_dir):
    return _matches(spark, sf_dir, "in AND NOT the")


@query(f"{DOCS} {_has('aich')} UNION (SELECT doc_id FROM docs EXCEPT {_has('the')})")
def bool_or_not(spark, sf_dir):
    return _matches(spark, sf_dir, "aich OR NOT the")


@query(f"{DOCS} {_has('the')} INTERSECT {_has('and')}")
def implicit_and(spark, sf_dir):
    return _matches(spark, sf_dir, "the and")


@query(f"{PART} SELECT DISTINCT doc_id FROM p WHERE term = 'small'")
def multi_field_bare(spark, sf_dir):
    return _matches(spark, sf_dir, "small", "part")


@query(f"{PART} SELECT doc_id FROM p WHERE term = 'small' AND field_id = 2 INTERSECT SELECT doc_id FROM p WHERE term = 'red' AND field_id = 1")
def field_qualified(spark, sf_dir):
    return _matches(spark, sf_dir, "type:SMALL AND name:red", "part")


@query(f"{DOCS} {_has('aich')} UNION ({_has('the')} INTERSECT ({_has('in')} EXCEPT {_has('to')}))")
def precedence_mix(spark, sf_dir):
    return _matches(spark, sf_dir, "aich OR the AND in AND NOT to")


@query(f"{DOCS} {_has('no-such-term')}")
def unknown_term_empty(spark, sf_dir):
    return _matches(spark, sf_dir, "no-such-term AND the")


@query(f"{DOCS} SELECT doc_id FROM docs")
def not_unknown_all(spark, sf_dir):
    return _matches(spark, sf_dir, "NOT no-such-term")


# ---- scoring ----


@query(f"{DOCS} SELECT doc_id, 7.5 :: DOUBLE AS score FROM (SELECT doc_id FROM docs EXCEPT {_has('the')})")
def constant_score(spark, sf_dir):
    engine = Engine(index_of(spark, sf_dir))
    p = engine.plan("NOT the").program
    return engine.hits(ExecutionPlan.of(Program((*p.nodes, ConstantScore(p.root, 7.5)), len(p.nodes))), Bm25Scorer())


@query(_top("term = 'the'", 10))
def bm25_topk(spark, sf_dir):
    return _rounded(Engine(index_of(spark, sf_dir)).search("the", 10))


@query(_top("term IN ('the', 'aich')", 10))
def bm25_or_topk(spark, sf_dir):
    return _rounded(Engine(index_of(spark, sf_dir)).search("the OR aich", 10))


@query(_top("term IN ('the', 'in') AND doc_id IN (SELECT doc_id FROM p WHERE term IN ('the', 'in') GROUP BY doc_id HAVING count(*) = 2)", 10))
def bm25_and_topk(spark, sf_dir):
    return _rounded(Engine(index_of(spark, sf_dir)).search("the AND in", 10))


@query(_top("term = 'small' AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'red')", 20, PART))
def bm25_and_not_topk(spark, sf_dir):
    return _rounded(Engine(index_of(spark, sf_dir, "part")).search("small AND NOT red", 20))


@query(_top("term IN ('the', 'in')", 15, _cte("documents", "doc_id", {1: "text"}, 2.0, 0.5)))
def bm25_custom_params(spark, sf_dir):
    return _rounded(Engine(index_of(spark, sf_dir)).search("the OR in", 15, Bm25Scorer(Bm25Params(2.0, 0.5))))


@query(f"{DOCS}, w AS (SELECT term FROM f ORDER BY df DESC, term LIMIT {WIDE_TERMS}) SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, sum(s) AS s FROM sc WHERE term IN (SELECT term FROM w) GROUP BY doc_id) ORDER BY round(s, 6) DESC, doc_id DESC LIMIT 10")
def bm25_wide_or_topk(spark, sf_dir):
    index = index_of(spark, sf_dir)
    words = [r["term"] for r in index.terms.orderBy(F.desc("df"), "term").limit(WIDE_TERMS).collect()]
    build = ast.QueryBuilder()
    build.or_([build.term(w) for w in words])
    engine = Engine(index)
    return _rounded(engine.hits(engine.plan(build.build()), Bm25Scorer())).orderBy(F.desc("score"), F.desc("doc_id")).limit(10)


@query(f"""{PART}, w AS (SELECT doc_id, sum(tf * wt) AS wtf, sum(dl * wt) AS wdl FROM (SELECT *, CASE field_id WHEN 1 THEN 2.0 :: DOUBLE ELSE 1.0 :: DOUBLE END AS wt FROM p WHERE term = 'small') GROUP BY doc_id)
  SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, ln((n.n - df + 0.5) / (df + 0.5) + 1) * 2.2 * wtf / (wtf + 1.2 * (0.25 + 0.75 * wdl / 6.0)) AS s FROM w, n, (SELECT count(*) AS df FROM w)) ORDER BY s DESC, doc_id DESC LIMIT 20""")
def bm25f_weighted(spark, sf_dir):
    index = index_of(spark, sf_dir, "part")
    weight = F.when(F.col("field_id") == 1, 2.0).otherwise(1.0)
    fields = index.postings.where("term = 'small'").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("tf"), F.col("dl"), weight.alias("weight"))).alias("fields"))
    df = fields.agg(F.count(F.lit(1)).alias("df"))
    scored = fields.crossJoin(F.broadcast(df)).select("doc_id", bm25f_column(F.col("fields"), F.lit(6.0), F.lit(index.document_count), F.col("df")).alias("score"))
    return _rounded(scored.orderBy(F.desc("score"), F.desc("doc_id")).limit(20))


@query(f"{DOCS}, q AS ({_cte('documents', 'doc_id', {1: 'text'}, 2.0, 0.5)} SELECT doc_id, s FROM sc WHERE term = 'the') SELECT doc_id, round(t, 6) AS score FROM (SELECT sc.doc_id, sc.s * 0.7 + q.s * 0.3 AS t FROM sc JOIN q ON sc.doc_id = q.doc_id WHERE term = 'the') ORDER BY t DESC, doc_id DESC LIMIT 10")
def combined_scorer(spark, sf_dir):
    scorer = CombinedScorer(Bm25Scorer(), Bm25FScorer(Bm25Params(2.0, 0.5)), 0.7, 0.3)
    return _rounded(Engine(index_of(spark, sf_dir)).search("the", 10, scorer))


@query(f"{DOCS} SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, sum(CASE term WHEN 'the' THEN 2.5 :: DOUBLE ELSE 1.0 :: DOUBLE END * s) AS s FROM sc WHERE term IN ('the', 'in') GROUP BY doc_id) ORDER BY s DESC, doc_id DESC LIMIT 10")
def boosted_topk(spark, sf_dir):
    build = ast.QueryBuilder()
    build.or_([build.boost(build.term("the"), 2.5), build.term("in")])
    return _rounded(Engine(index_of(spark, sf_dir)).search(build.build(), 10))


@query(_top("term = 'the'", 10))
def block_max_topk(spark, sf_dir):
    engine = Engine(index_of(spark, sf_dir))
    plan = engine.plan("the")
    root = plan.program.nodes[plan.program.root]
    return _rounded(engine.block_max(root, 10)) if getattr(root, "term", None) else _rounded(engine.search("the", 10))


@query(f"SELECT DISTINCT a.doc_id FROM ({PLACED}) a JOIN ({PLACED}) b ON a.doc_id = b.doc_id AND b.term = 'the' AND b.i > a.i AND b.i - a.i - 1 <= 2 WHERE a.term = 'in'")
def phrase_slop(spark, sf_dir):
    engine = Engine(index_of(spark, sf_dir))
    return engine.hits(engine.plan(ast.phrase_with_slop(["in", "the"], 2)))


@query(f"{DOCS}, s2 AS (SELECT doc_id, ' ' || string_agg(term, ' ' ORDER BY i) || ' ' AS t FROM (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '{SPACE}'), lambda x: x <> '') AS l FROM documents)) GROUP BY doc_id) SELECT doc_id FROM s2 WHERE contains(t, ' in the ')")
def phrase_match(spark, sf_dir):
    engine = Engine(index_of(spark, sf_dir))
    return engine.hits(engine.plan(ast.phrase(["in", "the"])))


# ---- filters ----


def _filtered(spark: SparkSession, sf_dir: str, text: str, predicate: Predicate) -> DataFrame:
    engine = Engine(index_of(spark, sf_dir))
    p = engine.plan(text).program
    return engine.hits(ExecutionPlan.of(Program((*p.nodes, Filter(p.root, predicate)), len(p.nodes))))


def _where(condition: str) -> str:
    return f"{DOCS} SELECT p.doc_id FROM p JOIN documents d ON p.doc_id = d.doc_id WHERE term = 'in' AND {condition}"


@query(_top("term = 'the' AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')", 10))
def external_filter(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return _rounded(Engine(index).search("the", 10, filters=Slots({1: F.col("lang") == "en"})))


@query(_where("lang = 'en'"))
def external_filter_unscored(spark, sf_dir):
    engine = Engine(index_of(spark, sf_dir))
    slots = Slots({1: F.col("lang") == "en"})
    return engine.hits(engine.plan("in", slots), None, slots)


@query(f"{DOCS} SELECT p.doc_id FROM p JOIN documents d ON p.doc_id = d.doc_id WHERE term = 'in' AND lang = 'en' UNION {_has('aich')}")
def filter_at_its_node(spark, sf_dir):
    engine = Engine(index_of(spark, sf_dir))
    p = engine.plan("in OR aich").program
    at = next(i for i, n in enumerate(p.nodes) if getattr(n, "term", None) == "in")
    root = p.nodes[p.root]
    nodes = list(p.nodes) + [ExternalFilter(at, 1)]
    nodes[p.root] = type(root)(tuple(len(nodes) - 1 if c == at else c for c in root.children))
    return engine.hits(ExecutionPlan.of(Program(tuple(nodes), p.root)), None, Slots({1: F.col("lang") == "en"}))


@query(_top("term = 'the' AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 300) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", 10))
def filter_chain(spark, sf_dir):
    allowed = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _rounded(Engine(index_of(spark, sf_dir)).search("the", 10, filters=Slots({1: F.col("n_chars") > 300, 2: allowed})))


@query(_where("lang = 'de'"))
def predicate_eq(spark, sf_dir):
    return _filtered(spark, sf_dir, "in", Eq("lang", "de"))


@query(_where("n_chars BETWEEN 200 AND 2000"))
def predicate_range(spark, sf_dir):
    return _filtered(spark, sf_dir, "in", Range("n_chars", 200, 2000))


@query(_where("source IN ('src1', 'src2')"))
def predicate_in(spark, sf_dir):
    return _filtered(spark, sf_dir, "in", In("source", ("src1", "src2")))


@query(_where("(lang = 'en' OR n_chars > 5000) AND NOT source = 'src3'"))
def predicate_bool(spark, sf_dir):
    return _filtered(spark, sf_dir, "in", AllOf((AnyOf((Eq("lang", "en"), Range("n_chars", 5001))), NotP(Eq("source", "src3")))))


# ---- collectors, fusion, facets ----


@query(_top("term IN ('the', 'in')", 5).replace("SELECT doc_id, round(s, 6) AS score FROM", "SELECT doc_id, round(s, 6) AS score, count(*) OVER () AS n_matches FROM"))
def topk_and_count(spark, sf_dir):
    engine = Engine(index_of(spark, sf_dir))
    best = topk_with_count(engine.hits(engine.plan("the OR in"), Bm25Scorer()), 5)
    return best.select("doc_id", F.round("score", 6).alias("score"), "n_matches")


def _list(where: str, k: int) -> str:
    return f"SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY s DESC, doc_id DESC) AS rank FROM (SELECT doc_id, sum(s) AS s FROM sc WHERE {where} GROUP BY doc_id) ORDER BY s DESC, doc_id DESC LIMIT {k}"


def _fused(lists: str, k: str = "60.0") -> str:
    return f"{DOCS}, lists AS ({lists}), b AS (SELECT list_id, id, min(rank) AS rank FROM lists GROUP BY list_id, id), r AS (SELECT id, sum(1.0 :: DOUBLE / ({k} :: DOUBLE + rank) ORDER BY rank) AS s, min(rank) AS best FROM b GROUP BY id) SELECT id, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY round(s, 12) DESC, best, id DESC) AS INTEGER) AS rank FROM r"


_TWO = f"SELECT 0 AS list_id, * FROM ({_list(chr(39).join(['term = ', 'the', '']), 20)}) UNION ALL SELECT 1 AS list_id, * FROM ({_list(chr(39).join(['term = ', 'in', '']), 20)})"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(index_of(spark, sf_dir))
    one, two = (fusion.as_ranked(engine.hits(engine.plan(q), Bm25Scorer()), i, 20) for i, q in enumerate(("the", "in")))
    return one.unionByName(two)


def _merged(fused: DataFrame) -> DataFrame:
    return fused.select("id", F.round("score", 6).alias("score"), "rank")


@query(_fused(_TWO))
def rrf_two_lists(spark, sf_dir):
    return _merged(fusion.fuse(_lists(spark, sf_dir)))


@query(_fused(f"SELECT list_id, id, rank FROM ({_TWO}) UNION ALL SELECT list_id, id, rank + 7 AS rank FROM ({_TWO})"))
def rrf_dedup(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return _merged(fusion.fuse(lists.unionByName(lists.withColumn("rank", F.col("rank") + 7))))


@query(_fused(_TWO, "10.0"))
def rrf_custom_k(spark, sf_dir):
    return _merged(fusion.fuse(_lists(spark, sf_dir), fusion.FusionConfig(10.0)))


@query(f"{DOCS} SELECT lang AS value, count(*) AS n FROM p JOIN documents d ON p.doc_id = d.doc_id WHERE term = 'in' GROUP BY lang")
def facet_counts(spark, sf_dir):
    return facets.facet_counts(index_of(spark, sf_dir), _matches(spark, sf_dir, "in"), "lang")
