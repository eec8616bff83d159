"""Different texts under one id are nodes of their own."""

from quillon.llm import near_dedup


def test_other_text_of_a_copys_id_stays(spark):
    words = [f"w{i * 7919 % 1000}x" for i in range(200)]
    a, b = " ".join(words), " ".join(f"v{i * 104729 % 3000}y" for i in range(150))
    near = " ".join(["other", *words[1:]])
    d = spark.createDataFrame([(3, near), (5, a), (5, b), (8, b + " more")], "doc_id long, text string")
    got = {(r["doc_id"], r["group_id"]) for r in near_dedup.groups(d).collect()}
    assert got == {(3, 3), (5, 3), (5, 5), (8, 5)}
    assert {(r["doc_id"], r["text"]) for r in near_dedup.keep_one(d).collect()} == {(3, near), (5, b)}
