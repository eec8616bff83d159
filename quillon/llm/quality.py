"""Weak-label quality classifier.

Labelling rules look at every document's bytes and vote good, bad or nothing.
There are few patterns of votes (at most 3^9), so counting them over the whole corpus is all
that expectation-maximisation needs: it estimates each rule's chance of each
vote under either class, and a pattern's posterior. A linear scorer over hashed
byte trigrams, and two shares of repetition that trigrams can't show, is fitted
to the posteriors of a bounded sample, and scores all documents.

Defined results: a null text, an empty one, and one of white space alone gets
score null and keep false. Repeated rows score alike. An empty table gives an
empty result; a table without any text gives score null everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import _base

DIM = 1 << 16
CHUNK = 2 << 20
RULES = ("capitals", "signs", "bars", "shouts", "stops", "word_length", "letters", "repeats", "echoes")
DENSE = 2
#: For bad and for good texts: how a rule is expected to vote bad, good, nothing.
PRIOR = np.array([[0.15, 0.6, 0.25], [0.001, 0.8, 0.199]])


def repetition(texts: pa.Array) -> np.ndarray:
    """n x 2: share of words that equal the word before them, share of lines that occurred before in the text."""
    n = len(texts)
    words = _base.by_space(texts)
    same = np.zeros(len(words.index), bool)
    same[1:] = words.index[1:] == words.index[:-1]
    same[words.starts[:-1]] = False
    blank = pc.equal(words.unique, "").to_numpy(zero_copy_only=False)
    same &= ~blank[words.index]
    lines = _base.Words(pc.split_pattern(texts, "\n"))
    pairs = np.unique(lines.owner() * max(1, len(lines.unique)) + lines.index) // max(1, len(lines.unique))
    return np.stack([_base.sums(same, words.starts) / np.maximum(words.counts, 1), 1 - np.bincount(pairs, minlength=n) / np.maximum(lines.counts, 1)], 1)


def rule_votes(texts: pa.Array) -> np.ndarray:
    """n x rules of 0 bad, 1 good, 2 no vote."""
    n = len(texts)
    raw, off = _base.utf8_bytes(texts)
    before = np.concatenate([[0], raw[:-1]]) if len(raw) else raw
    two = before == 0xC3
    upper = ((raw >= 65) & (raw <= 90)) | (two & (raw >= 0x80) & (raw <= 0x9E))
    lower = ((raw >= 97) & (raw <= 122)) | (two & (raw >= 0x9F))
    ahead = raw >= 0xC0
    wide = ahead & (raw != 0xC3)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    signs = np.isin(raw, np.frombuffer(b"#$%&*<>{}[]\\^_~=@+|", np.uint8))
    count = lambda x: _base.sums(x, off)
    up, low, far, gaps = count(upper), count(lower), count(wide), count(blank)
    begin = ~blank & np.concatenate([[True], blank[:-1]]) if len(raw) else blank
    if len(raw):
        begin[off[:-1][off[:-1] < len(raw)]] = ~blank[off[:-1][off[:-1] < len(raw)]]
    words = np.maximum(count(begin), 1)
    chars = np.maximum(count((raw & 0xC0) != 0x80) - gaps, 1)
    letters = up + low + far
    echo, repeated = repetition(texts).T
    many = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, 2))

    cased = np.maximum(up + low, 1)
    # full stops and words of some length are habits of alphabets of Europe: texts of other letters get no vote
    known = far <= 0.5 * letters
    return np.stack([
        vote((up / cased > 0.5) & (cased > 20), up / cased < 0.2),
        vote(count(signs) / chars > 0.04, count(signs) / chars < 0.01),
        vote((count(raw == 124) / words > 0.15) & (words > 8), count(raw == 124) == 0),
        vote(count(raw == 33) / words > 0.25, count(raw == 33) / words < 0.05),
        vote(known & (words > 40) & (count(raw == 46) / words < 0.005), known & (count(raw == 46) / words > 0.02) & (count(raw == 46) / words < 0.4)),
        vote(known & ((chars / words > 14) | ((chars / words < 2) & (words > 8))), known & (chars / words >= 3) & (chars / words <= 10)),
        vote(letters / chars < 0.75, letters / chars > 0.88),
        vote((repeated > 0.6) & (many >= 5), repeated < 0.3),
        vote((echo > 0.15) & (words > 8), echo < 0.05),
    ], 1)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram, and where each text's begin; trigrams across texts are left out."""
    raw, off = _base.utf8_bytes(texts)
    r = raw.astype(np.uint32)
    if len(r) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    h = ((r[:-2] << 16 | r[1:-1] << 8 | r[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.zeros(len(r) + 1, np.int64)
    inside[off[:-1]] += 1
    ok = np.ones(len(h), bool)
    for back in (1, 2):
        cut = off[1:-1] - back
        ok[cut[(cut >= 0) & (cut < len(h))]] = False
    starts = np.concatenate([[0], np.cumsum(ok)])[np.minimum(off, len(h))]
    return h[ok].astype(np.int64), starts


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, rules x 2 classes x 3 votes, share of good).

    Kinds of bad text hardly overlap, so most rules call any one bad text good.
    It starts from "one bad vote is enough", and a prior as heavy as each class
    says that rules seldom call a good text bad; without it the rules that fire
    together would take the whole of a class.
    """
    post = np.where((patterns == 0).any(1), 0.05, 0.95)
    table, prior = np.full((patterns.shape[1], 2, 3), 1 / 3), 0.5
    onehot = (patterns[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        table = np.einsum("cp,prv->rcv", weight, onehot) + PRIOR[None] * (weight.sum(1) + 1)[None, :, None]
        table /= table.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        logit = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", onehot, np.log(table[:, 1] / table[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, table, prior


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # DIM trigram buckets, DENSE shares of repetition, bias
    rules: dict[str, dict[str, float]]  # each rule's estimated accuracies
    prior: float


def fit(hashed: list[np.ndarray], dense: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression of soft targets on each text's trigram shares, times 100, by Adagrad."""
    column, row, value = [], [], []
    for i, h in enumerate(hashed):
        u, c = np.unique(h, return_counts=True)
        column.append(u)
        row.append(np.full(len(u), i))
        value.append(100 * c / max(1, len(h)))
    column, row, value = np.concatenate(column), np.concatenate(row), np.concatenate(value)
    w, g2 = np.zeros(DIM + DENSE + 1), np.full(DIM + DENSE + 1, 1e-8)
    n = len(hashed)
    # both classes weigh the same, so that a rare one isn't given up
    share = np.clip(target.mean(), 0.05, 0.95)
    weight = target / share + (1 - target) / (1 - share)
    weight /= weight.sum()
    for _ in range(rounds):
        z = np.bincount(row, weights=w[column] * value, minlength=n) + 10 * dense @ w[DIM:-1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = (p - target) * weight
        g = np.concatenate([np.bincount(column, weights=e[row] * value, minlength=DIM), 10 * e @ dense, [e.sum()]])
        g[:-1] += decay * w[:-1]
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w.astype(np.float32)


@F.arrow_udf(T.IntegerType())
def _pattern(texts: pa.Array) -> pa.Array:
    powers = 3 ** np.arange(len(RULES))
    got = [rule_votes(part) @ powers for part in _base.chunks(texts, CHUNK)]
    return pa.array(np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32))


def train(docs: DataFrame, max_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Votes over all documents, then a scorer from the ``max_rows`` documents whose hashed id and text are least."""
    d = _base.pick(docs, doc_id=id_col, text=text_col).where("trim(text) != ''")
    votes = _base.materialize(d.select(F.xxhash64(F.lit(23), "doc_id").alias("h"), _pattern("text").alias("pattern")), "votes")
    # at most 3^9 patterns, whatever the corpus
    counted = votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    if not counted:
        return None
    codes = np.array([r["pattern"] for r in counted])
    patterns = codes[:, None] // 3 ** np.arange(len(RULES)) % 3
    post, table, prior = em(patterns, np.array([r["n"] for r in counted], float))
    last = votes.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    hashed = F.xxhash64(F.lit(23), "doc_id")
    sample = d.where(hashed <= F.lit(last)).orderBy(hashed, F.xxhash64("text")).limit(max_rows)
    texts = sample.select("text").toArrow()["text"].combine_chunks()
    of = dict(zip(codes.tolist(), post.tolist()))
    rows, dense, target = [], [], []
    for part in _base.chunks(texts, CHUNK):
        h, starts = trigrams(part)
        rows += [h[a:b] for a, b in zip(starts, starts[1:])]
        dense.append(repetition(part))
        target += [of[int(p)] for p in rule_votes(part) @ 3 ** np.arange(len(RULES))]
    accuracy = {name: {"bad": float(table[i, 0, 0]), "good": float(table[i, 1, 1])} for i, name in enumerate(RULES)}
    model = Model(fit(rows, np.concatenate(dense), np.array(target)), accuracy, float(prior))
    del texts, part, h, rows, dense
    _base.trim()
    return model


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of good; NaN where there is no text."""
    out = [np.zeros(0)]
    for part in _base.chunks(texts, CHUNK):
        h, starts = trigrams(part)
        n = np.maximum(np.diff(starts), 1)
        z = 100 * _base.sums(model.weights[h], starts) / n + 10 * repetition(part) @ model.weights[DIM:-1] + model.weights[-1]
        empty = pc.equal(pc.utf8_trim_whitespace(part), "").to_numpy(zero_copy_only=False)
        out.append(np.where(empty, np.nan, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    return np.concatenate(out)


def scored(text: Column | str, model: Model | None) -> Column:
    if model is None:
        return F.lit(None).cast("double")

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, model), from_pandas=True)

    return run(text)


def classify(docs: DataFrame, model: Model | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) for each row."""
    model = model or train(docs, id_col=id_col, text_col=text_col)
    d = _base.pick(docs, doc_id=id_col, text=text_col).select("doc_id", scored("text", model).alias("score"))
    return d.withColumn("keep", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def keep_good(docs: DataFrame, model: Model | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = model or train(docs, id_col=id_col, text_col=text_col)
    d, name = _base.plain(docs)
    return d.where(scored(d[name(text_col)], model) >= threshold).toDF(*docs.columns)
