"""A rare language has its place in the model."""

import pyarrow as pa

from quillon.llm import lang_id


def test_rare_language_is_a_candidate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de')").select("doc_id", "text", "lang").limit(300)
    rare = ["kivi lintu sataa metsässä vettä", "järvi jäätyy talvella hyvin paksuksi", "lintu lentää metsässä talvella"]
    d = docs.union(spark.createDataFrame([(10**9 + i, t, "fi") for i, t in enumerate(rare)], docs.schema)).cache()
    few = 20
    model = lang_id.train(d, max_rows=few)
    assert model.langs == ("de", "en", "fi")
    got = lang_id.label(pa.array([*rare, "metsässä sataa talvella vettä"]), model).to_pylist()
    assert [r["lang"] for r in got] == ["fi"] * 4
    told = lang_id.identify(docs, model).withColumnRenamed("lang", "got").join(docs, "doc_id")
    assert told.where("got = lang").count() >= 0.98 * docs.count()
