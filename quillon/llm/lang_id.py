"""Language identification of mixed text.

Script ranges narrow a word's candidates to the trained languages that are
written in its script (a tenth of their letters at least), and hashed character
n-grams score it for each of these. Several languages may share a script, and
one may use several. A script that no trained language uses stands for its
commonest language (DEFAULTS), Latin for none. Viterbi over the words, with a
penalty for each switch, labels spans. All texts of an Arrow chunk go through
it together, one word position at a time.

Defined results: a text without letters (null, empty, signs) is "und", share 0,
no spans, keep false. Words without letters take their neighbours' label.
Ties go to the language that comes first in ``langs``. Repeated rows are
labelled alike. Without labelled rows only scripts are told apart: Latin text
is then "und" too. A word of several scripts goes by the one of most of its
letters, of equals the first in SCRIPTS; any kana makes it Japanese. A language
has one label, whether it was trained or a script stands for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import _base

#: First and last code point of letters, and their script.
RANGES = (
    (0x41, 0x5A, "Latin"), (0x61, 0x7A, "Latin"), (0xAA, 0xAA, "Latin"), (0xBA, 0xBA, "Latin"), (0xC0, 0xD6, "Latin"), (0xD8, 0xF6, "Latin"), (0xF8, 0x24F, "Latin"), (0x1E00, 0x1EFF, "Latin"),
    (0x370, 0x3FF, "Greek"), (0x1F00, 0x1FFF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x531, 0x58F, "Armenian"), (0x591, 0x5F4, "Hebrew"), (0x600, 0x6FF, "Arabic"), (0x900, 0x97F, "Devanagari"),
    (0x980, 0x9FF, "Bengali"), (0xB80, 0xBFF, "Tamil"), (0xE00, 0xE7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0x20000, 0x31FFF, "Han"),
)
SCRIPTS = tuple(dict.fromkeys(name for *_, name in RANGES))
#: What a script is taken for where no trained language writes it.
DEFAULTS = {"Greek": "el", "Cyrillic": "ru", "Armenian": "hy", "Hebrew": "he", "Arabic": "ar", "Devanagari": "hi", "Bengali": "bn", "Tamil": "ta", "Thai": "th", "Georgian": "ka", "Hangul": "ko", "Kana": "ja", "Han": "zh"}
#: A language is a candidate for a script that so large a share of its letters is in.
LEAST_LETTERS = 0.1
DIM = 1 << 15
SHARES = 64
#: Of the sample, what the driver takes apart at once; its arrays are some 30 times that.
TRAIN_BYTES = 256 << 10
RESULT = "struct<lang:string,share:double,n_words:bigint,keep:boolean,spans:array<struct<lang:string,start:int,end:int>>>"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # DIM x langs: log-probability of an n-gram
    scripts: np.ndarray | None = None  # SCRIPTS x langs: who is a candidate; None for everyone

    def candidates(self) -> np.ndarray:
        return np.ones((len(SCRIPTS), len(self.langs)), bool) if self.scripts is None else self.scripts


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams of each word with a mark at both ends, and where each word's begin."""
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    chars, lengths = _base.codepoints(marked)
    chars = chars.astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = len(chars)
    last = np.zeros(n + 2, bool)
    last[starts[1:] - 1] = True
    pad = np.concatenate([chars, np.zeros(2, np.uint64)])
    a, b, c = chars, pad[1 : n + 1], pad[2 : n + 2]
    c = np.where(last[:n] | last[1 : n + 1], np.uint64(0), c)
    b = np.where(last[:n], np.uint64(0), b)
    m = np.uint64(0x9E3779B97F4A7C15)
    cut = np.uint64(64 - 15)
    one = a * m
    two = (one ^ b) * m
    three = (two ^ c) * m
    return np.stack([(one >> cut), (two >> cut), (three >> cut)], 1).astype(np.int64).ravel(), starts * 3


def train(docs: DataFrame, max_rows: int = 1200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit n-gram scores for every language of the labelled rows, on a bounded sample of each: those ``max_rows`` whose hashed id is least.

    Ids and languages alone are looked at to find the sample; then its rows are read whole.
    """
    d = _base.pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null and lang != 'und' and text is not null")
    d = d.withColumn("h", F.xxhash64(F.lit(17), "doc_id"))
    # the least of each share of a language first, so that no task sorts the whole of a common one
    least = lambda rows, *by: rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("at") <= max_rows)
    some = least(d.select("lang", "h", F.pmod("h", F.lit(SHARES)).alias("share")), "lang", "share")
    cuts = least(some.select("lang", "h"), "lang").groupBy("lang").agg(F.max("h").alias("cut"))
    cuts = _base.materialize(cuts, "cuts").withColumnRenamed("lang", "of")
    rows = least(d.join(F.broadcast(cuts), (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("cut"))).select("lang", "text", "h"), "lang").orderBy("lang", "h").select("lang", "text").toArrow()
    if not rows.num_rows:
        return Model((), np.zeros((DIM, 0), np.float32))
    langs = tuple(sorted(set(rows["lang"].to_pylist())))
    counts, letters = np.zeros((DIM, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    for i, lang in enumerate(langs):
        texts = rows.filter(pc.equal(rows["lang"], lang))["text"].combine_chunks()
        for part in _base.chunks(texts, TRAIN_BYTES):
            words = _base.by_space(pc.replace_substring_regex(pc.utf8_lower(part), r"\s", " "))
            grams, starts = _grams(words.unique)
            times = np.bincount(words.index, minlength=len(words.unique))
            counts[:, i] += np.bincount(grams, weights=np.repeat(times, np.diff(starts)), minlength=DIM)
            kind = _SCRIPTS[_base.codepoints(part)[0]]
            letters[:, i] += np.bincount(kind[kind >= 0], minlength=len(SCRIPTS))
    counts += 0.05
    model = Model(langs, np.log(counts / counts.sum(0)).astype(np.float32), (letters > 0) & (letters >= LEAST_LETTERS * letters.sum(0)))
    del rows, texts, part, words, grams, starts, times, kind, counts
    _base.trim()
    return model


def _script_table() -> np.ndarray:
    """The place in SCRIPTS by code point; -1 for what is no letter."""
    table = np.full(0x110000, -1, np.int8)
    for lo, hi, name in RANGES:
        table[lo : hi + 1] = SCRIPTS.index(name)
    return table


_SCRIPTS = _script_table()


def word_scores(words: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words x (langs + 1) scores, each word's script or -1 where it has no letter); all 0 where there is none.

    The last state stands for words in scripts that no trained language uses.
    """
    k = len(model.langs)
    chars, lengths = _base.codepoints(words)
    kind = _SCRIPTS[chars]
    at = np.flatnonzero(kind >= 0)
    votes = np.bincount(np.repeat(np.arange(len(words)), lengths)[at] * len(SCRIPTS) + kind[at], minlength=len(words) * len(SCRIPTS)).reshape(len(words), len(SCRIPTS))
    script = np.where(votes.any(1), votes.argmax(1), -1)
    script[votes[:, SCRIPTS.index("Kana")] > 0] = SCRIPTS.index("Kana")
    scores = np.zeros((len(words), k + 1), np.float32)
    may = model.candidates()[np.maximum(script, 0)] & (script >= 0)[:, None]
    some = may.any(1)
    scores[(script >= 0) & ~some, :k] = -1e4
    scores[some, k] = -1e4
    rows = np.flatnonzero(some)
    if len(rows):
        grams, at = _grams(pc.utf8_lower(words.take(pa.array(rows))))
        got = np.where(may[rows], np.add.reduceat(model.table[grams], at[:-1], axis=0) / 3, np.float32(-np.inf))
        scores[rows, :k] = np.maximum(got - got.max(1, keepdims=True), np.float32(-1e4))
    return scores, script


def viterbi(scores: np.ndarray, index: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every word; ``scores[index]`` are the words' scores, ``starts`` where each text begins."""
    counts = np.diff(starts)
    order = np.argsort(-counts, kind="stable")
    first, counts = starts[:-1][order], counts[order]
    n, k = len(index), scores.shape[1]
    best = np.zeros((len(counts), k), np.float32)
    top = np.zeros(n, np.uint8)
    stay = np.zeros((n, k), bool)
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        m = active[t]
        at = first[:m] + t
        e = scores[index[at]]
        v = best[:m]
        if t:
            arg = v.argmax(1)
            switch = v[np.arange(m), arg] - penalty
            keep = v >= switch[:, None]
            top[at], stay[at] = arg, keep
            v = np.where(keep, v, switch[:, None])
        v = v + e
        best[:m] = v - v.max(1, keepdims=True)
    state = best.argmax(1)
    out = np.zeros(n, np.uint8)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        now = state[:m]
        out[at] = now
        if t:
            state[:m] = np.where(stay[at, now], now, top[at])
    return out


def label(texts: pa.Array, model: Model, penalty: float = 6.0, least_share: float = 0.5) -> pa.StructArray:
    names = (*model.langs, *(x for x in dict.fromkeys(DEFAULTS.values()) if x not in model.langs), "und")
    k = len(model.langs)
    und = len(names) - 1
    stands = np.array([names.index(DEFAULTS.get(x, "und")) for x in SCRIPTS])
    alone = ~model.candidates().any(1)
    whole: list[list[np.ndarray]] = []
    for part in _base.chunks(texts):
        spaced = pc.utf8_trim(pc.replace_substring_regex(part, r"\s+", " "), " ")
        words = _base.Words(pc.split_pattern(spaced, " "))
        scores, script = word_scores(words.unique, model)
        states = viterbi(scores, words.index, words.starts, penalty).astype(np.int64)
        script = script[words.index]
        n, owner = len(part), words.owner()
        letters = script >= 0
        # within the last state the word's own script names it; a word without letters takes the one before it, or else after it
        tags = states
        if len(script):
            own = letters & alone[np.maximum(script, 0)]
            place = np.arange(len(script))
            seen = np.maximum.accumulate(np.where(own, place, -1))
            ahead = np.minimum.accumulate(np.where(own, place, len(script) - 1)[::-1])[::-1]
            near = np.where((seen >= 0) & (owner[np.maximum(seen, 0)] == owner), seen, ahead)
            tags = np.where(states < k, states, np.where(own[near], stands[np.maximum(script[near], 0)], und))
        some = np.bincount(owner, weights=letters, minlength=n) > 0
        tags = np.where(some[owner], tags, und)
        votes = np.bincount((owner * len(names) + tags)[letters], minlength=n * len(names)).reshape(n, len(names))
        main = votes.argmax(1)
        total = votes.sum(1)
        main = np.where(total > 0, main, und)
        share = np.where(main < und, votes[np.arange(n), main] / np.maximum(total, 1), 0.0)
        new = np.ones(len(tags), bool)
        new[1:] = (tags[1:] != tags[:-1]) | (owner[1:] != owner[:-1])
        new &= some[owner]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(tags))
        end = np.minimum(end, words.starts[owner[begin] + 1]) if len(begin) else end[:0]
        spans_n = np.bincount(owner[begin], minlength=n)
        whole.append([main, share, total, spans_n, tags[begin], begin - words.starts[owner[begin]], end - words.starts[owner[begin]]])
    main, share, total, spans_n, tag, begin, end = (np.concatenate(x) for x in zip(*whole)) if whole else [np.zeros(0, np.int64)] * 7
    lookup = np.array(names, object)
    spans = pa.StructArray.from_arrays([pa.array(lookup[tag.astype(np.int64)], pa.string()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["lang", "start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans_n)]).astype(np.int32)), spans)
    keep = (main < und) & (share >= least_share)
    return pa.StructArray.from_arrays([pa.array(lookup[main.astype(np.int64)], pa.string()), pa.array(share.astype(np.float64)), pa.array(total.astype(np.int64)), pa.array(keep), lists], ["lang", "share", "n_words", "keep", "spans"])


def labelled(text: Column | str, model: Model, penalty: float = 6.0, least_share: float = 0.5) -> Column:
    """Main language, its share of the words with letters, whether to keep the text, and spans of word positions."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        return label(texts, model, penalty, least_share)

    return run(text)


def identify(docs: DataFrame, model: Model | None = None, penalty: float = 6.0, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, share, n_words, keep, spans) for each row."""
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    d = _base.pick(docs, doc_id=id_col, text=text_col)
    return d.select("doc_id", labelled("text", model, penalty, least_share).alias("r")).select("doc_id", "r.*")


def keep_identified(docs: DataFrame, model: Model | None = None, penalty: float = 6.0, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose main language holds at least ``least_share`` of its words."""
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        return label(texts, model, penalty, least_share).field("keep")

    d, name = _base.plain(docs)
    return d.where(kept(d[name(text_col)])).toDF(*docs.columns)
