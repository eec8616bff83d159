"""The codec against all segmentations, and its two routes against each other."""

import itertools
import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm import piece_codec, pieces

VOC = pieces.from_scores({"▁": -2.0, "a": -1.5, "b": -2.5, "ab": -1.0, "▁a": -1.2, "ba": -3.0, "aba": -2.2, "bb": -5.0, ",": -3.0, "c": -2.0, "▁c": -4.0})


def best(part):
    """Of all segmentations the best, of equals the one with the longest last piece, and so on backwards."""
    found = []
    for k in range(len(part)):
        for at in itertools.combinations(range(1, len(part)), k):
            cut = [part[i:j] for i, j in zip((0, *at), (*at, len(part)))]
            if any(p not in VOC.ids and len(p) > 1 or i and p[0] == "▁" and len(p) > 1 for i, p in enumerate(cut)):
                continue
            ids = [VOC.ids[p] if p in VOC.ids and not (i and p[0] == "▁") else -1 for i, p in enumerate(cut)]
            score = sum(piece_codec.micro(VOC.logp[p]) if x >= 0 else piece_codec.micro(VOC.byte_logp) * len(p.encode()) for x, p in zip(ids, cut))
            found.append((score, [len(p) for p in reversed(cut)], ids))
    return max(found)[2]


def test_words_against_all_segmentations(spark):
    rng = random.Random(4)
    words = sorted({"▁" + "".join(rng.choice("aaabbc,é") for _ in range(rng.randint(0, 9))) for _ in range(150)} | {"▁", "▁a▁b", "a", "é", "▁▁"})
    table = spark.createDataFrame([(w, [1]) for w in words], "word string, units array<int>")
    got = {r["word"]: r["ids"] for r in piece_codec.encode_words(table, VOC).collect()}
    assert got == {w: best(w) for w in words}
    assert all(piece_codec.viterbi(w, VOC) == best(w) for w in words)


def test_long_words_take_the_same_way(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (198, 199, 200, 201, 500)]
    texts += [f"x {t} y" for t in texts]
    rows = piece_codec.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary=VOC).collect()
    for r in rows:
        want = [i for w in texts[r["doc_id"]].split(" ") for i in piece_codec.spelled("▁" + w, piece_codec.viterbi("▁" + w, VOC), VOC)]
        assert r["ids"] == want
    both = spark.createDataFrame([("▁" + t[:199], [0]) for t in texts[:5]], "word string, units array<int>")
    assert all(r["ids"] == piece_codec.viterbi(r["word"], VOC) for r in piece_codec.encode_words(both, VOC).collect())


def test_parts():
    words = pa.array(["", "abc", "a,b", ",a", "a▁b,", "a\x00,", "né-é1\n"])
    flat, starts = piece_codec.parts(words, True)
    got = [flat.to_pylist()[a:b] for a, b in zip(starts, starts[1:])]
    assert got == [["▁"], ["▁abc"], ["▁a", ",", "b"], ["▁,", "a"], ["▁a▁b,"], ["▁a\x00,"], ["▁né", "-", "é", "1\n"]]
    assert piece_codec.parts(words, False)[0].to_pylist() == ["▁" + w for w in words.to_pylist()]
    assert pieces.load().cut and not pieces.from_scores({"▁": -1.0, "a,": -2.0}).cut


def test_rows_that_moved_are_still_encoded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab ba, é"), (2, None), (3, ""), (3, ""), (None, "a")], "doc_id long, text string")
    want = sorted(map(repr, piece_codec.encode(docs, vocabulary=VOC).collect()))
    monkeypatch.setattr(piece_codec, "encode_words", lambda words, voc: words.select("word", "units", F.array(F.lit(0)).alias("ids")).where("false"))
    assert sorted(map(repr, piece_codec.encode(docs, vocabulary=VOC).collect())) == want
