"""LM scoring by subword lattice likelihood.

A text's probability is the sum, over every way to segment it into pieces, of
the product of the pieces' probabilities. No piece crosses a space, so the sum
factorises over words; each distinct word of an Arrow chunk is scored once, by
a log-space forward recursion that runs over all words of the chunk together.
Texts never leave their partition. What is gathered from the whole corpus is
every document's score, for its exact rank within its language: distinct scores
with their counts are sorted by range, and running counts give the ranks.

The pieces' probabilities are the vocabulary's own where it is a unigram model.
The file at hand is a BPE model, whose scores are merge ranks: these are turned
into a Zipf law (pieces.from_scores), which is an assumption and not trained.

Defined results: a null or empty text has log_prob 0, bits_per_char null and no
rank (bucket null). A repeated row gives a repeated row, with the same rank; equal scores
share a rank. A null language is a language of its own. A character outside
the vocabulary is the product of its byte pieces.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import _base, pieces

_HASH = np.uint64(0x9E3779B97F4A7C15)
SUB = 32768


class Lattice:
    """A trie over pieces whose transitions are an open-addressing table, walked by whole arrays at a time."""

    def __init__(self, vocabulary: pieces.Vocabulary):
        self.byte_logp, self.longest = vocabulary.byte_logp, vocabulary.longest
        edges: dict[int, int] = {}
        score = [-np.inf]
        for piece, logp in vocabulary.logp.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(score)
                    score.append(-np.inf)
            score[node] = logp
        self.score = np.array(score)
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.full(1 << self.bits, -1, np.int32)
        mask = (1 << self.bits) - 1
        keys = np.fromiter(edges, np.int64, len(edges))
        for key, at, node in zip(keys.tolist(), self._slot(keys).tolist(), edges.values()):
            while self.keys[at] >= 0:
                at = at + 1 & mask
            self.keys[at], self.to[at] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        keys = node.astype(np.int64) << 21 | char
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.to[at], -1)
        wait = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(wait):
            at[wait] = (at[wait] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[wait]]
            hit = seen == keys[wait]
            out[wait[hit]] = self.to[at[wait[hit]]]
            wait = wait[~hit & (seen >= 0)]
        return out

    def score_words(self, words: pa.Array) -> np.ndarray:
        """Marginal log-probability of each word, which must begin with the space mark where it follows a space."""
        return np.concatenate([np.zeros(0), *(self._score(words.slice(i, SUB)) for i in range(0, len(words), SUB))])

    def _score(self, words: pa.Array) -> np.ndarray:
        chars, lengths = _base.codepoints(words)
        n = len(chars)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        word = np.repeat(np.arange(len(lengths)), lengths)
        rel = np.arange(n) - starts[word]
        left = lengths[word] - rel
        chars = chars.astype(np.int64)
        at, node = np.arange(n), np.zeros(n, np.int64)
        from_, length, logp = [], [], []
        for size in range(1, self.longest + 1):
            if size > 1:
                ok = left[at] >= size
                at, node = at[ok], node[ok]
            if not len(at):
                break
            node = self._step(node, chars[at + size - 1])
            s = np.where(node >= 0, self.score[node], -np.inf)
            whole = s > -np.inf
            if size == 1 and not whole.all():
                odd = at[~whole]
                c = chars[odd]
                from_.append(odd)
                length.append(np.ones(len(odd), np.int64))
                logp.append(self.byte_logp * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
            from_.append(at[whole])
            length.append(np.full(int(whole.sum()), size))
            logp.append(s[whole])
            at, node = at[node >= 0], node[node >= 0]
        # node t of word w is at starts[w] + w + t; edges go in order of where they end, then of their length
        alpha = np.full(n + len(lengths), -np.inf)
        alpha[starts[:-1] + np.arange(len(lengths))] = 0.0
        if n:
            f, k, s = np.concatenate(from_), np.concatenate(length), np.concatenate(logp)
            group = (rel[f] + k) * (self.longest + 1) + k
            order = np.argsort(group.astype(np.uint16) if group.max() < 65536 else group, kind="stable")
            f, s, group = f[order], s[order], group[order]
            k = k[order]
            a = f + word[f]
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for i, j in zip(cuts, cuts[1:]):
                to = a[i:j] + k[i]
                alpha[to] = np.logaddexp(alpha[to], alpha[a[i:j]] + s[i:j])
        return alpha[starts[1:] + np.arange(len(lengths))]


@functools.lru_cache(maxsize=2)
def _lattice(directory: str, name: str) -> Lattice:
    return Lattice(pieces.load(directory, name))


def log_probs(texts: pa.Array, lattice: Lattice) -> np.ndarray:
    """Natural log of each text's marginal probability."""
    out = [np.zeros(0)]
    for part in _base.chunks(texts):
        words = _base.by_space(part)
        marked = pa.compute.binary_join_element_wise(pieces.SPACE, words.unique, "")
        per = lattice.score_words(marked)
        # added up from 0 for each text, so that equal texts have equal scores wherever they are
        got = np.bincount(words.owner(), weights=per[words.index], minlength=len(part))
        got[pa.compute.binary_length(part).to_numpy(zero_copy_only=False) == 0] = 0.0
        out.append(got)
    return np.concatenate(out)


def log_prob(text: Column | str, directory: str = _base.TOKENIZER_DIR, name: str = pieces.PIECE_FILE) -> Column:
    """log_prob as a column; the vocabulary file is read once by each Python worker."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(log_probs(texts, _lattice(directory, name)))

    return run(text)


def score(docs: DataFrame, directory: str = _base.TOKENIZER_DIR, name: str = pieces.PIECE_FILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_chars, log_prob, bits_per_char, lang_rank, lang_pct, bucket).

    lang_rank counts from 1, the most probable text of a language first;
    lang_pct is (rank - 1) / (n - 1), and bucket its third: head, middle, tail.
    """
    d = _base.pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    d = d.select("doc_id", "lang", n.alias("n_chars"), log_prob("text", directory, name).alias("log_prob"))
    bits = F.when(F.col("n_chars") > 0, -F.col("log_prob") / F.lit(math.log(2)) / F.col("n_chars"))
    d = _base.materialize(d.withColumn("bits_per_char", bits), "lm_score")
    some = d.where("bits_per_char is not null")
    # equal scores are counted before they are shuffled, and stored by range, so that ranges give the ranks of the next
    values = some.groupBy("lang", "bits_per_char").agg(F.count(F.lit(1)).alias("c")).repartitionByRange("lang", "bits_per_char").withColumn("range", F.spark_partition_id())
    values = _base.materialize(values, "score_values")
    ranges, by_lang, upto = values.groupBy("lang", "range").agg(F.sum("c").alias("n")), Window.partitionBy("lang"), lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.select("lang", "range", (F.sum("n").over(upto(by_lang.orderBy("range"))) - F.col("n")).alias("before"), F.sum("n").over(by_lang).alias("in_lang"))
    ranges = ranges.withColumnRenamed("lang", "of_lang").withColumnRenamed("range", "of_range")
    values = values.join(ranges, values.lang.eqNullSafe(ranges.of_lang) & (values.range == ranges.of_range))
    rank = F.col("before") + F.sum("c").over(upto(Window.partitionBy("lang", "range").orderBy("bits_per_char"))) - F.col("c") + 1
    values = values.select(F.col("lang").alias("l"), F.col("bits_per_char").alias("b"), rank.cast("long").alias("lang_rank"), "in_lang")
    ranked = some.join(values, some.lang.eqNullSafe(values.l) & (some.bits_per_char == values.b))
    rank = F.col("lang_rank")
    pct = F.when(F.col("in_lang") > 1, (rank - 1) / (F.col("in_lang") - 1)).otherwise(F.lit(0.0))
    names = ["doc_id", "lang", "n_chars", "log_prob", "bits_per_char"]
    ranked = ranked.select(*names, rank, pct.alias("lang_pct"))
    none = d.where("bits_per_char is null").select(*names, F.lit(None).cast("long").alias("lang_rank"), F.lit(None).cast("double").alias("lang_pct"))
    third = F.when(F.col("lang_pct") < 1 / 3, "head").when(F.col("lang_pct") < 2 / 3, "middle").when(F.col("lang_pct").isNotNull(), "tail")
    return ranked.unionByName(none).withColumn("bucket", third)
