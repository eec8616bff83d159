"""Operators that SQL can't express against versions without Spark."""

import bisect
import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import exact_dedup, fertility, lang_id, lm_score, near_dedup, packing, quality, token_file, tokens

WORDS = ["".join(np.random.default_rng(i).choice(list("abcdefghijklmnop"), 3 + i % 6)) for i in range(2000)]


def text(rng, n=80):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def test_groups_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        base = text(rng).split()
        for _ in range(rng.integers(1, 4)):
            copy = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                copy[at] = WORDS[rng.integers(0, 2000)]
            texts.append(" ".join(copy))
    texts += ["", None, "!! ?", texts[0], text(rng, 30_000)]
    prints, _, n = near_dedup.fingerprints(pa.array(texts, pa.string()))
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            d = int((bits[i] != bits[j]).sum())
            if n[i] and n[j] and d <= near_dedup.MAX_DISTANCE:
                root[max(find(i), find(j))] = min(find(i), find(j))
                near += d > 0
    assert near > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.groups(docs).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if find(i) == find(j)]
    assert all(find(i) == find(g) for i, g in got.items())
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs)


def test_sure_to_meet():
    """Eleven wrong bits in the seven segments, however they fall, leave a common key in each role."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        a = rng.integers(0, 1 << 62, (1, 4)).astype(np.uint64)
        bits = np.unpackbits(a.view(np.uint8), axis=1, bitorder="little")
        bits[0, rng.choice(161, 11, replace=False)] ^= 1
        b = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        assert set(near_dedup.list_keys(a, True)[0].tolist()) & set(near_dedup.list_keys(b, False)[0].tolist())


def test_packing_tiers_fit_filling_and_balance(spark):
    rng = np.random.default_rng(6)
    tiers, group = (64, 128, 256), 4
    sizes = [int(x) for x in np.concatenate([rng.integers(1, 60, 150), rng.integers(60, 700, 60)])]
    rows = [(i, "x" * n) for i, n in enumerate(sizes)] + [(7, "x" * sizes[7])] * 2 + [(None, "y" * 50)] * 3 + [(5, "z" * 33), (6, ""), (8, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tiers, group).collect()
    want = collections.Counter((i, len(t)) for i, t in rows if t)
    seen = collections.defaultdict(list)
    for r in got:
        seen[r["doc_id"], r["doc_tokens"], r["copy"]].append((r["start"], r["n_tokens"], r["context"]))
    assert collections.Counter(k[:2] for k in seen) == want
    for (_, n, _), parts in seen.items():
        assert sorted(p[0] for p in parts) == [x for x in np.cumsum([0, *(p[1] for p in sorted(parts))])[:-1]] and sum(p[1] for p in parts) == n
        for start, k, context in parts:
            # whole windows of the longest size, and the rest in the least tier that holds it, or as a filling of a longer one
            assert (k == tiers[-1] == context) or (start == n - k and context >= tiers[bisect.bisect_left(tiers, k)])
    windows = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["place"]):
        windows[r["context"], r["shard"], r["window"]].append(r)
    used = collections.defaultdict(dict)
    for (context, shard, w), parts in windows.items():
        assert [p["offset"] for p in parts] == [int(x) for x in np.cumsum([0, *(p["n_tokens"] for p in parts)])[:-1]]
        fill = sum(p["n_tokens"] for p in parts)
        assert fill <= context and len({p["step_group"] for p in parts}) == 1
        used[context][shard, w] = (fill, parts)
    # own pieces by best fit decreasing: the fullest window that holds a piece, of equals the oldest
    for context in tiers:
        own = [p for _, parts in used[context].values() for p in parts if bisect.bisect_left(tiers, p["n_tokens"]) == tiers.index(context)]
        own.sort(key=lambda p: (-p["n_tokens"], p["doc_id"] is not None, str(p["doc_id"]), p["doc_tokens"], p["copy"], p["start"]))
        levels, where = [], {}
        for p in own:
            fits = [(context - x - p["n_tokens"], i) for i, x in enumerate(levels) if x + p["n_tokens"] <= context]
            i = min(fits)[1] if fits else len(levels)
            levels[i : i + 1] = [levels[i] + p["n_tokens"]] if fits else [p["n_tokens"]]
            where[id(p)] = i
        assert all(p["window"] == where[id(p)] for p in own)
    # a gap of the longest windows that a shorter piece fits in isn't left while the next tier packs that piece
    for context, below in ((256, (64, 128)), (128, (64,))):
        packed = [p["n_tokens"] for b in below for _, parts in used[b].values() for p in parts if bisect.bisect_left(tiers, p["n_tokens"]) == tiers.index(b)]
        assert all(context - fill < min(packed, default=1 << 30) for fill, _ in used[context].values())
    for context in tiers:
        ranked = sorted(used[context].items(), key=lambda x: (-x[1][0], x[0]))
        groups = -(-len(ranked) // group)
        for rank, (_, (_, parts)) in enumerate(ranked):
            lap, at = divmod(rank, groups)
            assert parts[0]["step_group"] == (at if lap % 2 == 0 else groups - 1 - at)


def test_packed_tokens_are_those_of_the_token_file(spark):
    docs = spark.createDataFrame([(i, text(np.random.default_rng(i), 30 * i)) for i in range(1, 20)], "doc_id long, text string")
    index = token_file.write(docs, f"{spark.conf.get('spark.checkpoint.dir')}/token_file_lengths")
    first = {r["doc_id"]: r["n_tokens"] for r in index.collect()}
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pack(docs, length=packing.token_lengths()).collect()} == first
    assert {r["doc_id"]: r["n_tokens"] for r in index.collect()} == first


def test_snapshot_is_stored_and_ids_may_be_strings(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    old, new = make([("a", "one"), ("b", "two"), ("c", "one"), ("n", None)]), make([("d", "two"), ("e", "three"), ("f", "three"), ("g", "four"), (None, "one")])
    path = f"{spark.conf.get('spark.checkpoint.dir')}/snapshot"
    saved = exact_dedup.Snapshot.save(old, path)
    for snapshot in (saved, exact_dedup.Snapshot.open(old, path), old):
        assert {tuple(r) for r in exact_dedup.duplicates(new, snapshot).collect()} == {("d", "b", "snapshot"), ("f", "e", "batch")}
    both = old.union(new)
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.keep_one(both).collect()]
    assert collections.Counter(t for i, t in kept if i is not None) == {"one": 1, "two": 1, "three": 1, "four": 1, None: 1} and len(kept) == 6


def test_em_against_documents_one_by_one():
    rng = np.random.default_rng(0)
    votes = np.where(rng.random((300, 4)) < 0.3, 2, rng.integers(0, 2, (300, 4)))
    prior = quality.PRIOR
    post = np.where((votes == 0).any(1), 0.05, 0.95)
    for _ in range(100):
        table = np.zeros((4, 2, 3))
        for r in range(4):
            for c, weight in enumerate((1 - post, post)):
                for v in range(3):
                    table[r, c, v] = sum(w for w, x in zip(weight, votes[:, r]) if x == v) + prior[c, v] * (weight.sum() + 1)
                table[r, c] /= table[r, c].sum()
        good = (post.sum() + 1) / (len(post) + 2)
        likely = [[share * math.prod(table[r, c, x] for r, x in enumerate(row)) for c, share in ((0, 1 - good), (1, good))] for row in votes]
        new = np.array([b / (a + b) for a, b in likely])
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6:
            break
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    got, accuracy, share = quality.em(patterns, counts.astype(float))
    assert got[which] == pytest.approx(post, abs=1e-4) and accuracy == pytest.approx(table, abs=1e-3) and share == pytest.approx(good, abs=1e-3)


def test_fit_finds_the_separating_weights():
    h = [np.array([1, 1, 2]), np.array([3, 3, 2]), np.array([1, 4, 4]), np.array([3, 5])]
    w = quality.fit(h, np.zeros((4, 2)), np.array([1.0, 0.0, 1.0, 0.0]))
    z = [100 * sum(w[x] for x in row) / len(row) + w[-1] for row in h]
    assert min(z[0], z[2]) > 0 > max(z[1], z[3])


def test_votes_of_other_scripts():
    rules = dict(zip(quality.RULES, range(9)))
    texts = ["यह एक सरल वाक्य है। " * 12, "这是一个简单的句子，写得很好。" * 20, "これは簡単な文です。" * 20, "A plain sentence of several words. " * 9, "WHY NOT SHOUT ALL DAY LONG" * 3, "a|b|c|d " * 20, "w " * 50]
    votes = quality.rule_votes(pa.array(texts))
    for i in range(3):
        assert votes[i, rules["stops"]] == votes[i, rules["word_length"]] == 2
        assert not (votes[i, [rules[x] for x in ("capitals", "signs", "bars", "shouts", "letters")]] == 0).any()
    assert votes[3, rules["stops"]] == votes[3, rules["word_length"]] == 1
    assert votes[4, rules["capitals"]] == 0 and votes[5, rules["bars"]] == 0 and votes[6, rules["echoes"]] == 0 and votes[6, rules["word_length"]] == 0


def test_judge_against_lists(spark):
    rng = np.random.default_rng(2)
    rows = [(i, text(rng, int(rng.integers(5, 200))), "en" if i % 2 else "de") for i in range(160)]
    rows += [(500, "zq" * 300, "en"), (501, "the " * 90, "de"), (502, text(rng, 100), "xx"), (503, "zz " * 100, "xx"), (504, None, "en"), (505, "", None)]
    bpe, piece = tokens.byte_bpe(), tokens.piece_bpe()
    low, high = fertility._byte_range("/opt/tokenizers", tokens.PIECE_FILE)
    measured = {}
    for i, t, lang in rows:
        if not t:
            measured[i] = None
            continue
        n, ids = len(bpe.whole([t])[0]), piece.whole([t])[0]
        counts = collections.Counter(ids).values()
        entropy = math.log2(len(ids)) - sum(c * math.log2(c) for c in counts) / len(ids)
        measured[i] = (lang, int(math.log2(n)) if n < 64 else -1, len(t) / n, sum(low <= x < high for x in ids) / len(ids), entropy)

    def band(values, bins):
        at = sorted(math.floor(v * bins) for v in values)
        q = lambda share: next(b for k, b in enumerate(at, 1) if at.count(b) and sum(x <= b for x in at) >= len(at) * share)
        q1, q3 = q(0.25) / bins, q(0.75) / bins + 1 / bins
        return q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)

    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, m in measured.items():
        if m is None:
            assert got[i]["keep"] is None and got[i]["reason"] == "empty"
            continue
        peers = [x for x in measured.values() if x and x[:2] == m[:2]]
        if len(peers) < 30:
            peers = [x for x in measured.values() if x and x[1] == m[1]]
        reason = ""
        if len(peers) >= 30:
            for k, (name, bins) in enumerate(fertility.MEASURES.items(), 2):
                lo, hi = band([x[k] for x in peers], bins)
                if not reason and not lo - 1e-9 <= m[k] <= hi + 1e-9:
                    reason = name
        assert got[i]["reason"] == reason and got[i]["keep"] == (reason == "")
        assert [got[i][x] for x in fertility.MEASURES] == pytest.approx(m[2:], abs=1e-9)
    assert got[503]["keep"] is False and got[502]["keep"]


def test_leading_and_double_spaces():
    texts = [" lead", "a  b", " ", "x ", "  y z", "plain words"]
    for e in (tokens.piece_bpe(), tokens.byte_bpe()):
        ids, n = e.encode(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(n)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == e.whole(texts)


def test_ranks_against_sorting(spark):
    rng = np.random.default_rng(4)
    rows = [(i, text(rng, int(rng.integers(1, 12))), ["en", "de", None][i % 3]) for i in range(60)]
    rows += [(i, rows[0][1], "en") for i in range(100, 140)] + [(200, None, "en"), (201, "", "de")]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    per = {i: -lm_score.log_probs(pa.array([t]), lm_score._lattice("/opt/tokenizers", "piece_bpe_32k.model"))[0] / math.log(2) / len(t) if t else None for i, t, _ in rows}
    for i, t, lang in rows:
        if not t:
            assert got[i]["lang_rank"] is None and got[i]["bucket"] is None and got[i]["log_prob"] == 0
            continue
        peers = [per[j] for j, u, x in rows if u and x == lang]
        rank = 1 + sum(p < per[i] - 1e-12 for p in peers)
        assert got[i]["lang_rank"] == rank and got[i]["lang_pct"] == pytest.approx((rank - 1) / (len(peers) - 1))
        assert got[i]["bucket"] == ("head" if got[i]["lang_pct"] < 1 / 3 else "middle" if got[i]["lang_pct"] < 2 / 3 else "tail")


def test_scripts_with_several_languages(spark):
    uk = ["їжак живе в лісі і їсть ґрибы", "щось є цікаве в її книзі", "ця річка тече швидко"]
    ru = ["ёжик живёт в лесу и ест грибы", "что-то интересное есть в её книге", "эта река течёт быстро"]
    en = ["the hedgehog lives in the wood", "something is of interest in the book", "this river is fast"]
    rows = [(3 * k + i, t, lang) for k, (lang, texts) in enumerate((("uk", uk), ("ru", ru), ("en", en))) for i, t in enumerate(texts)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ("en", "ru", "uk")
    seen = dict(zip(lang_id.SCRIPTS, model.scripts.tolist()))
    assert seen["Cyrillic"] == [False, True, True] and seen["Latin"] == [True, False, False] and not any(seen["Greek"])
    got = lang_id.label(pa.array(["її їжак є в цій книзі", "ёжик есть в этой книге", "the river", "η γλώσσα", "the river її їжак живе в лісі", None]), model).to_pylist()
    assert [r["lang"] for r in got] == ["uk", "ru", "en", "el", "uk", "und"]
    assert [(s["lang"], s["start"], s["end"]) for s in got[4]["spans"]] == [("en", 0, 2), ("uk", 2, 7)]
