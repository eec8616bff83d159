"""Quality rules from tokeniser fertility.

Two public vocabularies encode every text: characters per token of a byte-level
BPE, share of byte-fallback ids and entropy of the ids of a piece vocabulary.
Bands are learnt for each language (or, without one, each script) over all
documents: quartiles of binned values, widened by a multiple of their distance.
A document outside any band of its group is rejected. The measures of a short
text depend on its length, so texts of fewer than ``least_tokens`` tokens have
bands of their own for each doubling of the length.

Defined results: a null or empty text has null measures and is not judged: keep
is null, reason "empty". Repeated rows are judged alike. A null or blank
language is replaced by the text's main script. Where a group has fewer than
``least_group`` documents of a length class, the bands of all groups' documents
of that length judge them; where these are fewer too, they are kept: there is
too little to judge by.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import _base, tokens

MEASURES = {"chars_per_token": 64, "fallback_share": 512, "entropy": 32}
STATS = "struct<n_tokens:bigint,chars_per_token:double,fallback_share:double,entropy:double>"


def entropies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of each text's ids."""
    owner = np.repeat(np.arange(len(counts)), counts)
    key = np.sort(owner << 17 | ids)
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(key)]]))
    who = key[at] >> 17
    n = np.maximum(counts, 1)
    return np.log2(n) - np.bincount(who, weights=times * np.log2(np.maximum(times, 1)), minlength=len(counts)) / n


def measures(text: Column | str, directory: str = _base.TOKENIZER_DIR, bpe: str = tokens.BPE_FILE, piece: str = tokens.PIECE_FILE) -> Column:
    @F.arrow_udf(STATS)
    def run(texts: pa.Array) -> pa.Array:
        got: list[list[np.ndarray]] = []
        low, high = _byte_range(directory, piece)
        for part in _base.chunks(texts):
            _, n = tokens.byte_bpe(directory, bpe).encode(part)
            ids, m = tokens.piece_bpe(directory, piece).encode(part)
            back = _base.sums((ids >= low) & (ids < high), np.concatenate([[0], np.cumsum(m)]))
            chars = pc.utf8_length(part).to_numpy(zero_copy_only=False)
            got.append([n, chars / np.maximum(n, 1), back / np.maximum(m, 1), entropies(ids.astype(np.int64), m)])
        columns = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64), *[np.zeros(0)] * 3]
        none = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0)
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["n_tokens", *MEASURES], mask=none)

    return run(text)


def _byte_range(directory: str, piece: str) -> tuple[int, int]:
    from quillon.llm import pieces

    ids = pieces.load(directory, piece).byte_ids
    return min(ids), max(ids) + 1


SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Katakana", "Hiragana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai", "other")


@functools.lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """The place in SCRIPTS of each letter, by code point; -1 where it isn't a letter."""
    points = np.delete(np.arange(0x110000), np.arange(0xD800, 0xE000))
    signs = pa.array(map(chr, points.tolist()))
    letters = pc.match_substring_regex(signs, r"\pL")
    points, signs = points[letters.to_numpy(zero_copy_only=False)], signs.filter(letters)
    table = np.full(0x110000, -1, np.int8)
    table[points] = len(SCRIPTS) - 1
    for i, name in enumerate(SCRIPTS[:-1]):
        table[points[pc.match_substring_regex(signs, rf"\p{{{name}}}").to_numpy(zero_copy_only=False)]] = i
    return table


def scripts(texts: pa.Array) -> pa.Array:
    """The script of most of each text's letters, of equals the first in SCRIPTS; "other" where there are none, null for null."""
    most = [np.zeros(0, np.int64)]
    for part in _base.chunks(texts):
        chars, lengths = _base.codepoints(part)
        kind = _script_table()[chars] if len(chars) else np.zeros(0, np.int8)
        owner = np.repeat(np.arange(len(part)), lengths)[kind >= 0]
        votes = np.bincount(owner * len(SCRIPTS) + kind[kind >= 0], minlength=len(part) * len(SCRIPTS)).reshape(len(part), len(SCRIPTS))
        most.append(np.where(votes.any(1), votes.argmax(1), len(SCRIPTS) - 1))
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), pa.array(SCRIPTS).take(pa.array(np.concatenate(most))))


def script(text: Column | str) -> Column:
    """The script of most of a text's letters: enough to group texts that have no language."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return scripts(texts)

    return run(text)


def bands(measured: DataFrame, width: float) -> DataFrame:
    """(grp, size, docs, and low and high of each measure) by exact quartiles of the binned values."""
    result = None
    for name, bins in MEASURES.items():
        by = Window.partitionBy("grp", "size").orderBy("bin")
        counts = measured.groupBy("grp", "size", F.floor(F.col(name) * bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        counts = counts.withColumn("upto", F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(Window.partitionBy("grp", "size")))
        q = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("bin"))) / bins
        one = counts.groupBy("grp", "size").agg(F.max("all").alias("docs"), q(0.25).alias("q1"), (q(0.75) + 1 / bins).alias("q3"))
        reach = width * (F.col("q3") - F.col("q1"))
        one = one.select("grp", "size", *([F.col("docs")] if result is None else []), (F.col("q1") - reach).alias(f"{name}_low"), (F.col("q3") + reach).alias(f"{name}_high"))
        result = one if result is None else result.join(one, ["grp", "size"])
    return result


def judge(docs: DataFrame, directory: str = _base.TOKENIZER_DIR, width: float = 3.0, least_tokens: int = 64, least_group: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, grp, n_tokens, chars_per_token, fallback_share, entropy, keep, reason)."""
    d = _base.pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    lang = F.nullif(F.trim("lang"), F.lit(""))
    group = F.coalesce(lang, script(F.when(lang.isNull(), F.col("text"))), F.lit("other"))
    d = _base.materialize(d.select("doc_id", group.alias("grp"), measures("text", directory).alias("m")).select("doc_id", "grp", "m.*"), "fertility")
    d = d.withColumn("size", F.when(F.col("n_tokens") < least_tokens, F.floor(F.log2("n_tokens"))).otherwise(-1))
    b = _base.materialize(bands(d.where("n_tokens is not null"), width), "bands")
    # no group has an empty name: that one is all of them
    every = _base.materialize(bands(d.where("n_tokens is not null").withColumn("grp", F.lit("")), width), "bands_of_all").drop("grp")
    every = every.select(F.col("size").alias("of_size"), *[F.col(c).alias(f"all_{c}") for c in every.columns if c != "size"])
    j = d.join(b, ["grp", "size"], "left").join(every, F.col("size") == F.col("of_size"), "left")
    few = F.coalesce(F.col("docs") < least_group, F.lit(True))
    reason = F.when(F.col("n_tokens").isNull(), "empty").when(few & F.coalesce(F.col("all_docs") < least_group, F.lit(True)), "")
    for name in MEASURES:
        low, high = (F.when(few, F.col(f"all_{name}_{end}")).otherwise(F.col(f"{name}_{end}")) for end in ("low", "high"))
        reason = reason.when((F.col(name) < low) | (F.col(name) > high), name)
    j = j.withColumn("reason", reason.otherwise(""))
    keep = F.when(F.col("reason") != "empty", F.col("reason") == "")
    return j.select("doc_id", "grp", "n_tokens", *MEASURES, keep.alias("keep"), "reason")
