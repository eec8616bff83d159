"""Piece vocabularies: reading a .model file and giving its pieces log-probabilities."""

from __future__ import annotations

import functools
import math
import os
from dataclasses import dataclass

import regex

from quillon.llm._base import TOKENIZER_DIR

SPACE = "▁"
PIECE_FILE = "piece_bpe_32k.model"
#: Whitespace runs and the like carry a prohibitive score in the file; they take no part in a lattice.
ABSENT = -1e8
_CROSSES = regex.compile(r"[\p{L}\p{M}][^\p{L}\p{M}]|[^\p{L}\p{M}][\p{L}\p{M}]")


@dataclass(frozen=True)
class Vocabulary:
    """``logp`` and ``ids`` by piece; ``byte_logp`` is what each byte of a character outside the vocabulary costs."""

    logp: dict[str, float]
    ids: dict[str, int]
    byte_logp: float
    byte_ids: tuple[int, ...]
    texts: tuple[bytes, ...]

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.logp), default=1)

    @functools.cached_property
    def cut(self) -> bool:
        """Whether no piece holds a letter beside another character, the mark in front aside."""
        return not any(_CROSSES.search(p.removeprefix(SPACE)) for p in self.logp)


def from_scores(scores: dict[str, float], ranks: bool = False) -> Vocabulary:
    """A vocabulary of given pieces. With ``ranks`` a score of -r is a merge rank r and not a log-probability.

    Ranks become a Zipf law, p ~ 1 / (r + 10), normalised over the pieces and
    the 256 byte pieces, which count as the rarest rank.
    """
    pieces = list(scores)
    if ranks:
        worst = max((-s for s in scores.values()), default=0.0) + 1
        weight = {p: 1 / (10 - s) for p, s in scores.items()}
        total = sum(weight.values()) + 256 / (10 + worst)
        logp = {p: math.log(w / total) for p, w in weight.items()}
        byte = math.log(1 / (10 + worst) / total)
    else:
        logp = dict(scores)
        byte = min(scores.values(), default=0.0) - 10
    texts = tuple(bytes([b]) for b in range(256)) + tuple(p.replace(SPACE, " ").encode() for p in pieces)
    return Vocabulary(logp, {p: 256 + i for i, p in enumerate(pieces)}, byte, tuple(range(256)), texts)


@functools.lru_cache(maxsize=4)
def load(directory: str = TOKENIZER_DIR, name: str = PIECE_FILE) -> Vocabulary:
    """Read a .model file. Unigram scores are used as they are; a BPE file's are ranks, see from_scores."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(os.path.join(directory, name), "rb") as f:
        model.ParseFromString(f.read())
    scores, ids, byte_ids, texts = {}, {}, [0] * 256, []
    byte_scores = []
    for i, p in enumerate(model.pieces):
        texts.append(p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else b"")
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
            byte_scores.append(p.score)
            texts[-1] = bytes([int(p.piece[3:5], 16)])
        elif p.type == 1 and p.score > ABSENT:
            if SPACE in p.piece[1:] or "\n" in p.piece:
                raise ValueError(f"piece {p.piece!r} crosses words")
            scores[p.piece] = p.score
            ids[p.piece] = i
        elif p.piece == SPACE:
            ids[SPACE] = i
    if SPACE in ids and SPACE not in scores:  # a lone space is needed; it counts as the rarest piece
        scores[SPACE] = min(scores.values(), default=0.0) - 1
    made = from_scores(scores, ranks=model.trainer_spec.model_type == 2)
    return Vocabulary(made.logp, ids, made.byte_logp, tuple(byte_ids), tuple(texts))
