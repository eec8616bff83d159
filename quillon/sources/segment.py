"""A compact binary export of an index, and its validating view.

24 bytes of header (magic LSEG, version, four counts), a directory of four
sections (kind, offset, length), then the sections. All numbers are
little-endian. Lengths, aliases and analyzers aren't part of it, so it is an
export and not a way to store an index; Index.save is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from enum import IntEnum

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import DuplicateSection, InvalidMagic, MissingSection, OutOfBoundsSection, OverlappingSections, SegmentError, TruncatedDirectory, TruncatedHeader, UnknownSection, UnsupportedVersion, ValueOutOfRange
from quillon.sources.index import Index

MAGIC, VERSION = b"LSEG", 1
HEADER = struct.Struct("<4sHHIIII")
ENTRY = struct.Struct("<III")
WORD = 1 << 32


class SectionKind(IntEnum):
    TERM_DICTIONARY = 1
    FIELD_METADATA = 2
    POSTINGS_METADATA = 3
    POSTINGS_PAYLOAD = 4


def encode(documents: int, terms: list[tuple[int, int, str]], fields: list[tuple[int, int, int]], postings: list[tuple[int, list[tuple[int, int]]]]) -> bytes:
    """Bytes of (term_id, field, term), (field, documents, tokens) and (term_id, [(doc, tf)])."""
    try:
        words = [struct.pack("<I", len(terms))]
        for term_id, f, term in sorted(terms):
            raw = term.encode()
            words.append(struct.pack("<III", f, term_id, len(raw)) + raw)
        about = [struct.pack("<I", len(fields)), *(struct.pack("<III", *x) for x in sorted(fields))]
        directory, payload, at = [struct.pack("<I", len(postings))], [], 0
        for term_id, pairs in sorted(postings):
            body = struct.pack(f"<I{2 * len(pairs)}I", len(pairs), *(n for pair in pairs for n in pair))
            directory.append(struct.pack("<IIII", term_id, at, len(body), len(pairs)))
            payload.append(body)
            at += len(body)
        sections = [b"".join(x) for x in (words, about, directory, payload)]
        out = [HEADER.pack(MAGIC, VERSION, 0, documents, len(terms), len(fields), len(sections))]
        at = HEADER.size + ENTRY.size * len(sections)
        for kind, body in zip(SectionKind, sections):
            out.append(ENTRY.pack(kind, at, len(body)))
            at += len(body)
        return b"".join(out + sections)
    except struct.error as e:
        raise ValueOutOfRange(str(e)) from e


def export(index: Index) -> bytes:
    """A whole index as bytes, gathered on the driver: for small ones."""
    ids = index.term_ids()
    rows = index.postings.join(ids.select("field_id", "term", "term_id"), ["field_id", "term"]).groupBy("term_id", "field_id", "term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p")).collect()
    terms = [(r["term_id"], r["field_id"], r["term"]) for r in rows]
    lists = [(r["term_id"], [(p["doc_id"], p["tf"]) for p in r["p"]]) for r in rows]
    return encode(index.document_count, terms, [(f, *s) for f, s in index.stats.items()], lists)


class SegmentView:
    """Checks in order: header, magic, version, directory; each entry's kind, repetition and bounds; that all are there; overlap."""

    def __init__(self, data: bytes, counts: tuple[int, int, int], sections: dict[SectionKind, tuple[int, int]]):
        self._data, self._sections = data, sections
        self.document_count, self.term_count, self.field_count = counts

    @classmethod
    def open(cls, data: bytes) -> SegmentView:
        if len(data) < HEADER.size:
            raise TruncatedHeader()
        magic, version, _, documents, terms, fields, count = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise InvalidMagic()
        if version != VERSION:
            raise UnsupportedVersion(version)
        body = HEADER.size + ENTRY.size * count
        if len(data) < body:
            raise TruncatedDirectory()
        found: dict[SectionKind, tuple[int, int]] = {}
        for i in range(count):
            number, offset, length = ENTRY.unpack_from(data, HEADER.size + ENTRY.size * i)
            if number not in SectionKind._value2member_map_:
                raise UnknownSection(number)
            kind = SectionKind(number)
            if kind in found:
                raise DuplicateSection(kind)
            if offset < body or offset + length > len(data):
                raise OutOfBoundsSection(kind)
            found[kind] = (offset, offset + length)
        for kind in SectionKind:
            if kind not in found:
                raise MissingSection(kind)
        spans = [(a, b, kind) for kind, (a, b) in found.items()]
        for i, (a, b, _) in enumerate(spans):
            for c, d, kind in spans[i + 1 :]:
                if a < d and c < b:
                    raise OverlappingSections(kind)
        return cls(data, (documents, terms, fields), found)

    def has_section(self, kind: SectionKind) -> bool:
        return kind in self._sections

    def section_bytes(self, kind: SectionKind) -> bytes:
        start, end = self._sections[kind]
        return self._data[start:end]


def decode(view: SegmentView) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]], list[tuple[int, list[tuple[int, int]]]]]:
    """What encode was given: (term_id, field, term), (field, documents, tokens) and (term_id, [(doc, tf)])."""
    body = view.section_bytes(SectionKind.TERM_DICTIONARY)
    terms, at = [], 4
    for _ in range(struct.unpack_from("<I", body)[0]):
        f, term_id, size = struct.unpack_from("<III", body, at)
        terms.append((term_id, f, body[at + 12 : at + 12 + size].decode()))
        at += 12 + size
    body = view.section_bytes(SectionKind.FIELD_METADATA)
    fields = [struct.unpack_from("<III", body, 4 + 12 * i) for i in range(struct.unpack_from("<I", body)[0])]
    body, payload = view.section_bytes(SectionKind.POSTINGS_METADATA), view.section_bytes(SectionKind.POSTINGS_PAYLOAD)
    lists = []
    for i in range(struct.unpack_from("<I", body)[0]):
        term_id, start, _, count = struct.unpack_from("<IIII", body, 4 + 16 * i)
        flat = struct.unpack_from(f"<{2 * count}I", payload, start + 4)
        lists.append((term_id, list(zip(flat[::2], flat[1::2]))))
    return terms, fields, lists


def inspect(files: DataFrame) -> DataFrame:
    """(path, document_count, term_count, field_count, error) of rows that spark.read.format("binaryFile") gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    v = SegmentView.open(bytes(content))
                    rows.append((path, v.document_count, v.term_count, v.field_count, None))
                except SegmentError as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "document_count", "term_count", "field_count", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, document_count long, term_count long, field_count long, error string")
