"""Occurrences of terms within batches of documents, grouped by column operations in the workers.

All tokens of a document are in one row, so its terms are counted where it is
read: a row for each occurrence, and a shuffle of these, isn't needed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.functions.analysis import BETWEEN, unescaped

#: Tokens that are grouped at once, a document's own at least, and postings in one row of a term.
TOKENS, POSTINGS = 1 << 21, 128


def _slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none but single rows has over TOKENS tokens; ``name`` has the tokens or their number."""
    for batch in batches:
        of = batch.column(name)
        ends = np.cumsum(_lengths(of) if pa.types.is_list(of.type) else of.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + TOKENS, "right")))
            yield batch.slice(at, end - at)
            at = end


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every token its row and the number of its term; the terms by number."""
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    return np.repeat(np.arange(len(lists)), _lengths(lists)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _begins(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def _lists(begins: np.ndarray, total: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[begins, total], pa.int32()), values)


def posting_lists(batches: Iterator[pa.RecordBatch], escaped: frozenset[int] = frozenset(), bounds: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """(field_id, term, part, posts) of (doc_id, field_id, toks, dl): a term's postings (doc_id, tf, dl) of some documents, by doc_id.

    ``escaped``: fields whose terms are escaped. ``bounds``: the least terms of
    all parts but the first; one that is there several times has its postings
    spread over the parts that it begins.
    """
    for whole in _slices(batches, "dl"):
        whole = whole.filter(pc.greater(whole.column("dl"), 0))
        for field_id in pc.unique(whole.column("field_id")).to_pylist():
            batch = whole.filter(pc.equal(whole.column("field_id"), field_id))
            rows, codes, words = _coded(pc.split_pattern(batch.column("toks"), BETWEEN))
            if field_id in escaped:
                words = pa.array([unescaped(w) for w in words.to_pylist()], pa.string())
            by_id = pc.sort_indices(batch.column("doc_id")).to_numpy()
            place = np.empty(len(by_id), np.int64)
            place[by_id] = np.arange(len(by_id))
            keys = np.sort(codes * len(by_id) + place[rows])
            first = _begins(keys)
            tf = np.diff(np.r_[first, len(keys)])
            code, row = np.divmod(keys[first], len(by_id))
            of_term = _begins(code)
            number = np.arange(len(code)) - np.repeat(of_term, np.diff(np.r_[of_term, len(code)]))
            begins = np.flatnonzero(number % POSTINGS == 0)
            row = pa.array(by_id[row])
            posts = pa.StructArray.from_arrays([batch.column("doc_id").take(row), pa.array(tf, pa.int32()), batch.column("dl").take(row)], ["doc_id", "tf", "dl"])
            part = np.zeros(len(begins), np.int64)
            if bounds:
                texts = words.to_pylist()
                last = [bisect_right(bounds, w) for w in texts]
                spread = [k - bisect_left(bounds, w, 0, k) if k and bounds[k - 1] == w else 1 for w, k in zip(texts, last)]
                part = np.array(last)[code[begins]] - np.arange(len(begins)) % np.array(spread)[code[begins]]
            columns = [pa.array(np.full(len(begins), field_id), pa.int32()), words.take(pa.array(code[begins])), pa.array(part, pa.int32()), _lists(begins, len(code), posts)]
            yield pa.RecordBatch.from_arrays(columns, ["field_id", "term", "part", "posts"])


def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, positions) of (doc_id, terms), one row for each term of a row."""
    for batch in _slices(batches, "terms"):
        rows, codes, words = _coded(batch.column("terms"))
        if not len(rows):
            continue
        keys = rows * len(words) + codes
        order = np.argsort(keys, kind="stable")
        begins = _begins(keys[order])
        row, code = np.divmod(keys[order][begins], len(words))
        place = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(_lengths(batch.column("terms")))[:-1]], _lengths(batch.column("terms")))
        columns = [words.take(pa.array(code)), batch.column("doc_id").take(pa.array(row)), pa.array(np.diff(np.r_[begins, len(rows)]), pa.int32()), _lists(begins, len(rows), pa.array(place[order], pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "tf", "positions"])
