"""The pipeline's stages against versions without Spark, and on odd rows."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quillon.llm import lang_id, near_dedup, quality, tokens

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    ids, texts = [r[0] for r in rows], pa.array([r[1] for r in rows], pa.string())
    stage = dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted(r["doc_id"] for r in stage[name](spark, docs, DIR).collect())
    keep = lang_id.label(texts, lang_id.train(docs)).field("keep").to_pylist()
    assert kept("language") == [i for i, k in zip(ids, keep) if k]
    good = quality.scores(texts, quality.train(docs)) >= 0.5
    assert kept("quality") == [i for i, k in zip(ids, good) if k]
    first: dict = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert kept("exact_dedup") == sorted(first.values())
    prints, _, n = near_dedup.fingerprints(texts)
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in np.flatnonzero((bits[:i] != bits[i]).sum(1) <= near_dedup.MAX_DISTANCE).tolist():
            if n[i] and n[j] and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {ids[i] for i in range(len(rows)) if find(i) == i}
    got = set(kept("near_dedup"))
    assert want <= got and len(got) <= 1.02 * len(want)
    packed = stage["packing"](spark, docs, DIR).groupBy("doc_id").sum("n_tokens").collect()
    counts = tokens.byte_bpe().encode(texts)[1].tolist()
    assert {r[0]: r[1] for r in packed} == {i: c for i, c in zip(ids, counts) if c}


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "en", 1), (None, "a text of some words. It has two parts.", "en", 2), (2, "", "en", 3), (3, "12 ?!", None, 4), (4, "one two", "en", 5), (4, "one two", "en", 5)], "doc_id long, text string, lang string, Text int")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd.limit(0), DIR)
        assert none.count() == 0
        got = stage(spark, odd, DIR)
        if name != "packing":
            assert got.columns == odd.columns
        left = sorted(map(repr, (r["doc_id"] for r in got.collect())))
        assert left == {"language": ["4", "4", "None"], "exact_dedup": ["1", "2", "3", "4", "None"], "near_dedup": ["1", "2", "3", "4", "4", "None"], "packing": ["3", "4", "4", "None"]}.get(name, left)
