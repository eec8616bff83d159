"""Text analysis: white-space tokens, canonical forms and case mapping.

``normalize`` defines the results. Columns take a built-in route for analyzers
on which built-ins are known to agree, and send the texts of others to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FIELDS = 1024
#: Unicode White_Space, for Java's and for Python's regular expressions.
JAVA_SPACE = r"[\t-\r \x{85}\p{Z}]+"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_TOKEN = re.compile(f"[^{_SPACE}]+")
_EDGES = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+$")
TOKEN_TYPE = "array<struct<text:string,position:int,start:int,end:int>>"


class Token(NamedTuple):
    """A token with its place among the tokens and its bytes in the UTF-8 text."""

    text: str
    position: int
    start: int
    end: int


def strip(text: str) -> str:
    return _EDGES.sub("", text)


def words(text: str) -> list[str]:
    return _TOKEN.findall(text)


class Tokenizer(Protocol):
    def tokenize(self, text: str, position: int = 0) -> list[Token]: ...


class WhitespaceTokenizer:
    """Splits at White_Space; nothing else is dropped and no token is empty."""

    def tokenize(self, text: str, position: int = 0) -> list[Token]:
        out, done, at = [], 0, 0
        for i, m in enumerate(_TOKEN.finditer(text)):
            at += len(text[done : m.start()].encode())
            size = len(m.group().encode())
            out.append(Token(m.group(), position + i, at, at + size))
            at, done = at + size, m.end()
        return out


@dataclass(frozen=True)
class NormalizerSpec:
    """form: none, NFC or NFKC; case: none, lower or fold."""

    form: str = "NFC"
    case: str = "lower"

    def __post_init__(self) -> None:
        if self.form not in ("none", "NFC", "NFKC") or self.case not in ("none", "lower", "fold"):
            raise ValueError(f"no such normalizer: {self.form}, {self.case}")

    def canonical(self, text: str) -> str:
        return text if self.form == "none" else unicodedata.normalize(self.form, text)

    def mapped(self, text: str) -> str:
        return {"none": text, "lower": text.lower(), "fold": text.casefold()}[self.case]

    def normalize(self, text: str) -> str:
        """Canonical form, case, canonical form again."""
        return self.canonical(self.mapped(self.canonical(text)))

    def needs_canonical_form(self, text: str) -> bool:
        return self.form != "none" and not unicodedata.is_normalized(self.form, text)

    def needs_case_mapping(self, text: str) -> bool:
        return self.mapped(text) != text

    def needs_normalize(self, text: str) -> bool:
        return self.normalize(text) != text

    @property
    def odd(self) -> str | None:
        """A regular expression of characters that built-ins can't be trusted with; None if there are none."""
        if self.case == "fold" or self.form == "NFKC":
            return r"[^\x00-\x7F]"
        return r"[\x{0300}-\x{10FFFF}]" if self.form == "NFC" else None


@dataclass(frozen=True)
class AnalyzerSpec:
    """A tokenizer, then normalizers in order; with none of them tokens stay as they are."""

    normalizers: tuple[NormalizerSpec, ...] = ()
    tokenizer: Tokenizer = field(default_factory=WhitespaceTokenizer, compare=False)

    @classmethod
    def default(cls) -> AnalyzerSpec:
        return cls((NormalizerSpec(),))

    def with_normalizer(self, spec: NormalizerSpec) -> AnalyzerSpec:
        return AnalyzerSpec((*self.normalizers, spec), self.tokenizer)

    def normalize(self, token: str) -> str:
        for n in self.normalizers:
            token = n.normalize(token)
        return token

    def analyze(self, text: str) -> list[tuple[Token, str]]:
        return [(t, self.normalize(t.text)) for t in self.tokenizer.tokenize(text)]

    @property
    def builtin(self) -> bool:
        return isinstance(self.tokenizer, WhitespaceTokenizer)


class FieldAnalyzers:
    """An analyzer for each field id."""

    def __init__(self, specs: dict[int, AnalyzerSpec] | None = None):
        self._of: dict[int, AnalyzerSpec] = {}
        for field_id, spec in (specs or {}).items():
            self.set(field_id, spec)

    def set(self, field_id: int, spec: AnalyzerSpec) -> None:
        if not 0 <= field_id < MAX_FIELDS:
            raise ValueError(f"field ids go from 0 to {MAX_FIELDS - 1}")
        self._of[field_id] = spec

    def get(self, field_id: int) -> AnalyzerSpec | None:
        return self._of.get(field_id)


def tokens(text: Column | str) -> Column:
    """White-space tokens as an array; null for null."""
    return F.filter(F.split(text, JAVA_SPACE), lambda x: x != "")


#: Those that str.split() takes for white space beside White_Space.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _split(text: str) -> list[str]:
    return words(text) if _SEPARATORS.search(text) else text.split()


def _analysed(spec: AnalyzerSpec) -> Callable[[str], list[str]]:
    """The terms of one text."""
    # canonical forms and case leave white space and what is none as they are, so a whole text is normalised before it is split; NFKC makes spaces
    if spec.builtin and all(n.form != "NFKC" for n in spec.normalizers):
        return lambda text: _split(spec.normalize(text))
    seen: dict[str, str] = {}

    def each(text: str) -> list[str]:
        row = []
        for t in spec.tokenizer.tokenize(text):
            if t.text not in seen:
                seen[t.text] = spec.normalize(t.text)
            row.append(seen[t.text])
        return row

    return each


def _python_terms(spec: AnalyzerSpec):
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        analysed = _analysed(spec)
        return pa.array([None if text is None else analysed(text) for text in texts.to_pylist()], pa.list_(pa.string()))

    return run


def terms(text: Column, spec: AnalyzerSpec) -> Column:
    """Normalised tokens of a text, in order; null for null.

    With a canonical form or case folding all texts go to Python, which costs
    less than built-ins' splitting by regular expressions.
    """
    if not spec.builtin or any(n.odd for n in spec.normalizers):
        return _python_terms(spec)(text)
    plain = text
    for n in spec.normalizers:
        plain = F.lower(plain) if n.case != "none" else plain
    return tokens(plain)


#: Between terms of a joined text: tokens of white space never hold it, those of other tokenizers have it escaped.
BETWEEN = "\n"


def escaped(term: str, spec: AnalyzerSpec) -> str:
    """A term as it is in a joined text."""
    return term if spec.builtin else term.replace("\\", "\\\\").replace(BETWEEN, "\\n")


def unescaped(term: str) -> str:
    return re.sub(r"\\(.)", lambda m: BETWEEN if m[1] == "n" else m[1], term)


def joined_terms(text: Column, spec: AnalyzerSpec) -> Column:
    """(toks, dl): the terms of a text, joined, and their number; a string costs far less to store and to send than an array."""
    if spec.builtin and not any(n.odd for n in spec.normalizers):
        return F.struct(F.array_join(terms(text, spec), BETWEEN).alias("toks"), F.size(terms(text, spec)).alias("dl"))

    @F.arrow_udf("struct<toks:string,dl:int>")
    def run(texts: pa.Array) -> pa.Array:
        analysed = _analysed(spec)
        rows = [analysed(text) if text is not None else [] for text in texts.to_pylist()]
        toks = [BETWEEN.join(r if spec.builtin else [escaped(x, spec) for x in r]) for r in rows]
        return pa.StructArray.from_arrays([pa.array(toks, pa.string()), pa.array(list(map(len, rows)), pa.int32())], ["toks", "dl"])

    return run(text)


def offset_tokens(text: Column | str, spec: AnalyzerSpec | None = None) -> Column:
    """Tokens with positions and byte offsets, their texts normalised if a spec is given."""

    @F.arrow_udf(TOKEN_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        tokenizer = spec.tokenizer if spec else WhitespaceTokenizer()
        out = []
        for value in texts.to_pylist():
            rows = None if value is None else [{"text": spec.normalize(t.text) if spec else t.text, "position": t.position, "start": t.start, "end": t.end} for t in tokenizer.tokenize(value)]
            out.append(rows)
        kind = pa.struct([("text", pa.string()), ("position", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(out, pa.list_(kind))

    return run(text)


def normalized(text: Column | str, spec: NormalizerSpec) -> Column:
    """A whole text's normal form, without splitting it."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else spec.normalize(t) for t in texts.to_pylist()], pa.string())

    return run(text)
