"""Packing by the tokenizer's ids."""

import collections

import pyarrow as pa

from quillon.llm import queries, tokens


def test_query_packs_tokens(spark):
    dir_ = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{dir_}/documents.parquet").collect()}
    want = dict(zip(texts, tokens.byte_bpe().encode(pa.array(list(texts.values())))[1].tolist()))
    got, ends = collections.Counter(), collections.Counter()
    for r in queries.op5_packing(spark, dir_).collect():
        got[r["doc_id"]] += r["n_tokens"]
        ends[r["doc_id"]] = max(ends[r["doc_id"]], r["start"] + r["n_tokens"])
    assert got == ends == {i: n for i, n in want.items() if n}
    bpe = tokens.byte_bpe().whole
    some = max(texts, key=lambda i: len(texts[i]))
    assert got[some] == len(bpe([texts[some]])[0])
