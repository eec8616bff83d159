"""The codec's query decodes what it encodes."""

import pyarrow as pa

from quillon.llm import piece_codec, pieces, queries


def test_query_decodes_all_texts(spark):
    dir_ = "/root/testdata/sf0.001"
    want = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{dir_}/documents.parquet").collect())
    rows = queries.op3_piece_codec(spark, dir_).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == want
    assert all(r["ids"] for r in rows if r["text"])
    again = piece_codec.decode(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in rows[:50]], "doc_id long, ids array<int>"))
    assert {r["doc_id"]: r["text"] for r in again.collect()} == {r["doc_id"]: r["text"] for r in rows[:50]}


def test_decode_in_chunks(monkeypatch):
    monkeypatch.setattr(piece_codec, "CHUNK_IDS", 5)
    voc = pieces.load()
    texts = ["ab cd", "", "é 😀 x", "a  b", "w" * 300]
    ids = [[i for w in t.split(" ") for i in piece_codec.spelled("▁" + w, piece_codec.viterbi("▁" + w, voc), voc)] if t else [] for t in texts]
    lists = pa.array([None, *ids, None], pa.list_(pa.int32()))
    assert piece_codec.decode_ids(lists, voc).to_pylist() == [None, *texts, None]
    assert piece_codec.decode_ids(lists.slice(2, 3), voc).to_pylist() == texts[1:4]
