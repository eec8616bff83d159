"""Public tokenizers over Arrow chunks: each distinct word is encoded once and kept by its worker.

Both tokenizers here cut before a single space, so a text's ids are those of
its first word and of " word" for each other word. A text that begins with a
space, or has two in a row, is encoded as a whole instead.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm import _base

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BPE_FILE, PIECE_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
MOST_WORDS = 300_000


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, for one i after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """``whole`` encodes texts, ``spaced`` words that follow a space."""

    def __init__(self, whole: Callable[[list[str]], list[list[int]]], spaced: Callable[[list[str]], list[list[int]]]):
        self.whole, self.spaced = whole, spaced
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used, self.first, self.length = 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _slot(self, words: list[str]) -> np.ndarray:
        if len(self.slots) > MOST_WORDS:
            self._reset()
        got = self.slots.get
        slots = [got(w, -1) for w in words]
        new = [w for w, s in zip(words, slots) if s < 0]
        if new:
            encoded = self.spaced(new)
            at = len(self.slots)
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter((x for e in encoded for x in e), np.int32, int(lengths.sum()))
            while len(self.first) < at + len(new):
                self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
            while len(self.ids) < self.used + len(flat):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.first[at : at + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.length[at : at + len(new)] = lengths
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.slots.update(zip(new, range(at, at + len(new))))
            slots = [got(w) for w in words]
        return np.array(slots, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and each text's number of ids."""
        n = len(texts)
        odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        words = _base.by_space(plain)
        heads = words.index[words.starts[:-1]]
        unique = words.unique.to_pylist()
        firsts = self.whole([unique[i] for i in heads])
        for i in np.flatnonzero(odd):
            firsts[i] = self.whole([texts[int(i)].as_py()])[0]
        slot = self._slot(unique)
        rest = np.ones(len(words.index), bool)
        rest[words.starts[:-1]] = False
        slot = slot[words.index[rest]]
        owner = words.owner()[rest]
        lengths = self.length[slot]
        head_n = np.fromiter(map(len, firsts), np.int64, n)
        rest_n = np.bincount(owner, weights=lengths, minlength=n).astype(np.int64)
        counts = head_n + rest_n
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[ragged(starts, head_n)] = np.fromiter((x for f in firsts for x in f), np.int32, int(head_n.sum()))
        out[ragged(starts + head_n, rest_n)] = self.ids[ragged(self.first[slot], lengths)]
        return out, counts


@functools.lru_cache(maxsize=2)
def byte_bpe(directory: str = _base.TOKENIZER_DIR, name: str = BPE_FILE) -> Encoder:
    import tiktoken

    with open(os.path.join(directory, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    one = bpe.encode_ordinary
    return Encoder(lambda texts: [one(t) for t in texts], lambda words: [one(" " + w) for w in words])


@functools.lru_cache(maxsize=2)
def piece_bpe(directory: str = _base.TOKENIZER_DIR, name: str = PIECE_FILE) -> Encoder:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(directory, name))
    empty = sp.encode("  ")[:1] and [sp.piece_to_id("▁")]

    def encode(texts: list[str]) -> list[list[int]]:
        return sp.encode(texts, num_threads=1) if texts else []

    def spaced(words: list[str]) -> list[list[int]]:
        return [e if w else empty for w, e in zip(words, encode(words))]

    return Encoder(encode, spaced)
