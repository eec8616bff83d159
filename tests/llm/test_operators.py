"""Each operator against brute force, a round trip or known cases."""

import collections
import itertools
import math
import os

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillon.llm import exact_dedup, fertility, fuse_filter, lang_id, lm_score, near_dedup, packing, piece_codec, pieces, quality, queries, token_file

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, Text string, key int, n int, h long, shard int, group_id long"
LONG = "Der Hund lief. " * 20_000
ROWS = [
    (1, "The cat sat on the mat. It was fine.", "en"), (1, "The cat sat on the mat. It was fine.", "en"), (2, None, "en"), (None, "abc def", "en"),
    (3, "", "en"), (4, "   ", None), (5, LONG, "de"), (6, "日本語 テキスト 😀", ""), (7, "The cat sat on the mat. It was fine.", "en"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


OPS = {
    "op1": (lm_score.score, len(ROWS)), "op2": (near_dedup.groups, len(ROWS)), "op3": (piece_codec.encode, len(ROWS)), "op5": (packing.pack, None), "op6": (exact_dedup.all_duplicates, None),
    "op7": (quality.classify, len(ROWS)), "op8": (fertility.judge, len(ROWS)), "op9": (lambda d: token_file.write(d, f"{d.sparkSession.conf.get('spark.checkpoint.dir')}/tok{id(d)}"), len(ROWS)), "op10": (lang_id.identify, len(ROWS)),
    "keep2": (near_dedup.keep_one, 8), "keep6": (exact_dedup.keep_one, 7), "keep7": (quality.keep_good, None), "keep10": (lang_id.keep_identified, None),
}


@pytest.mark.parametrize("name", list(OPS))
def test_odd_rows_and_empty_tables(spark, name):
    op, n = OPS[name]
    got = op(table(spark)).collect()
    assert n is None or len(got) == n
    assert op(table(spark, [])).count() == 0


def test_lm_score_is_the_sum_over_segmentations():
    voc = pieces.from_scores({"▁": -2.0, "a": -1.5, "b": -2.5, "ab": -1.0, "▁a": -1.2, "ba": -3.0, "aba": -2.2})
    lattice = lm_score.Lattice(voc)

    def brute(word):
        cuts = range(1, len(word))
        total = 0.0
        for k in range(len(word)):
            for at in itertools.combinations(cuts, k):
                parts = [word[i:j] for i, j in zip((0, *at), (*at, len(word)))]
                if all(p in voc.logp for p in parts):
                    total += math.exp(sum(voc.logp[p] for p in parts))
        return math.log(total)

    words = ["▁a", "▁abab", "▁baabab", "▁"]
    assert lattice.score_words(pa.array(words)) == pytest.approx([brute(w) for w in words])
    assert lm_score.log_probs(pa.array(["abab a", None, ""]), lattice) == pytest.approx([brute("▁abab") + brute("▁a"), 0, 0])


def test_golay_lists_hold_what_they_should():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    near, count = near_dedup.near_codewords(words)
    for bit in range(23):
        other = near_dedup.near_codewords(words ^ 1 << bit)[0][:, 0]
        assert all(o in n[:c] for o, n, c in zip(other.tolist(), near.tolist(), count.tolist()))
    assert set(count.tolist()) <= {1, 6}


def test_near_copies(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(3000)]
    rows, want = [], collections.defaultdict(set)
    for g in range(60):
        words = [vocabulary[i] for i in rng.integers(0, 3000, 120)]
        for c in range(1 + g % 4):
            mine = list(words)
            for at in rng.integers(0, 120, 4 * min(c, 1)):
                mine[at] = vocabulary[rng.integers(0, 3000)]
            rows.append((len(rows), " ".join(mine), "en"))
            want[g].add(len(rows) - 1)
    got = collections.defaultdict(set)
    for r in near_dedup.groups(table(spark, rows)).collect():
        got[r["group_id"]].add(r["doc_id"])
    assert all(any(g <= w for w in want.values()) for g in got.values())
    pairs = lambda groups: {p for g in groups for p in itertools.combinations(sorted(g), 2)}
    assert len(pairs(got.values())) >= 0.9 * len(pairs(want.values()))
    assert near_dedup.keep_one(table(spark, rows)).count() == len(got)


def test_pieces_round_trip(spark):
    texts = [r[1] for r in ROWS if r[0] is not None] + ["a  b\n\tc ▁ é", " x ", "w" * 500]
    d = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
    encoded = piece_codec.encode(d)
    assert {r["doc_id"]: r["text"] for r in piece_codec.decode(encoded).collect()} == dict(enumerate(texts))
    voc = pieces.load()
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    marked = ["▁" + w for w in texts[0].split(" ")]
    assert ids[0] == [i for w in marked for i in piece_codec.spelled(w, piece_codec.viterbi(w, voc), voc)]


def test_packing_covers_all_tokens_once(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 700, 80)]
    rows = packing.pack(table(spark, [(i, "x" * n, "en") for i, n in enumerate(sizes)]), tiers=(64, 128, 256)).collect()
    covered = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in rows:
        covered[r["doc_id"]].append((r["start"], r["n_tokens"]))
        windows[r["context"], r["shard"], r["window"]].append((r["offset"], r["n_tokens"]))
    for i, n in enumerate(sizes):
        at = 0
        for start, k in sorted(covered[i]):
            assert start == at
            at += k
        assert at == n
    for (context, _, _), parts in windows.items():
        size = context if context > 2 else (64, 128, 256)[context]
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at <= size


def test_exact_duplicates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"text {rng.integers(0, 60)}", "en") for i in range(150)]
    middle = 149 // 2
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    want = {(i, first[t], "snapshot" if first[t] <= middle else "batch") for i, t, _ in rows if first[t] != i}
    assert {tuple(r) for r in exact_dedup.all_duplicates(table(spark, rows)).collect()} == want
    assert {r["doc_id"] for r in exact_dedup.keep_one(table(spark, rows)).collect()} == set(first.values())


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    blob = fuse_filter.build(keys)
    assert fuse_filter.contains(blob, keys).all()
    assert fuse_filter.contains(blob, rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01


def test_votes_and_scorer_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in got}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))


def test_entropy():
    ids = np.array([1, 1, 2, 3, 7])
    assert fertility.entropies(ids, np.array([3, 0, 2])) == pytest.approx([-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)), 0, 1])


def test_bands_reject_labelled_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = fertility.judge(docs).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in got}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.4 * (n.get((0, False), 0) + n[0, True])


def test_short_texts_have_bands(spark):
    words = "the cat sat on a mat and saw that it was fine to be there in rain".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, 20)), "en") for i in range(200)]
    rows += [(900, "zq" * 10, "en"), (901, "the " * 20, "en")]
    kept = {r["doc_id"]: r["keep"] for r in fertility.judge(table(spark, rows)).collect()}
    assert not kept[900] and not kept[901]
    assert sum(kept.values()) >= 198


def test_script_is_that_of_most_letters(spark):
    texts = ["IBM https://x.org открыла завод в городе", "Да, this is an English text", "Ωmega and so on", "NASA องค์การบริหารการบินและอวกาศ", "ሰላም ለዓለም ok", "12 !?", "", None]
    want = ["Cyrillic", "Latin", "Latin", "Thai", "other", "other", "other", None]
    assert fertility.scripts(pa.array(texts)).to_pylist() == want
    rows = [(i, t, [None, " "][i % 2]) for i, t in enumerate(texts)] + [(9, texts[0], "bg")]
    assert {r["doc_id"]: r["grp"] for r in fertility.judge(table(spark, rows)).collect()} == {i: w or "other" for i, w in enumerate(want)} | {9: "bg"}


def test_token_file_round_trip(spark):
    texts = ["hello there", "", None, "a b c " * 300]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/token_round_trip"
    rows = token_file.write(table(spark, [(i, t, "en") for i, t in enumerate(texts)]), path, length=16, rows=4).collect()
    from quillon.llm import tokens

    whole, n = tokens.byte_bpe().encode(pa.array([t or "" for t in texts]))
    at = np.concatenate([[0], np.cumsum(n)])
    for r in rows:
        file = token_file.Sequences(r["file"])
        i = r["doc_id"]
        assert file.tokens(r["start"], r["n_tokens"]).tolist() == whole[at[i] : at[i + 1]].tolist()
        assert file.tokens(r["start"] + r["n_tokens"], 1).tolist() == [token_file.END_ID]
        assert file.mask(0).base is not None


def test_language_spans():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    index, penalty = np.array([0, 3, 5, 5, 8, 1, 2]), 0.7
    got = lang_id.viterbi(scores, index, np.array([0, 7]), penalty)
    value = lambda p: sum(scores[index[t], s] for t, s in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    assert value(got.tolist()) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=7)), abs=1e-4)


def test_mixed_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.train(docs)
    two = {r["lang"]: r["text"] for r in docs.where("n_chars between 300 and 900 and lang in ('en', 'de')").collect()}
    got = lang_id.label(pa.array([two["en"] + " " + two["de"] + " Это русский текст", "123 !!"]), model).to_pylist()
    assert [s["lang"] for s in got[0]["spans"]] == ["en", "de", "ru"]
    assert got[1] == {"lang": "und", "share": 0.0, "n_words": 0, "keep": False, "spans": []}


def test_sql_of_operators(spark):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{DIR}/{t}')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, DIR)
        names = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = corpus_pipeline.run(spark, DIR).collect()
    kept = {r["doc_id"] for r in rows}
    assert 0 < len(kept) < len(texts) and len({texts[i] for i in kept}) == len(kept)
    from quillon.llm import tokens

    assert sum(r["n_tokens"] for r in rows) == int(tokens.byte_bpe().encode(pa.array([texts[i] for i in kept]))[1].sum())
