"""SentencePiece-style encoding and decoding as relations.

Encoding takes two passes over the texts, which are never shuffled. The first
lists the distinct words of each input partition (a unit). Each distinct word
of the corpus is then exploded once into its substrings up to the longest
piece, these are joined to the piece table (its size is fixed by the
vocabulary and checked before it is broadcast), edges are grouped by word and
by where they end, and a higher-order ``aggregate`` folds Viterbi over them.
The words go back to the units that hold them, as one file a unit in the
shared folder. The second pass looks its unit's words up.

Decoding: ids index the pieces' bytes, which are joined and read as UTF-8, an
Arrow chunk at a time.

A word is a space and what follows it, the first word getting a space of its
own. Where no piece of the vocabulary holds a letter beside a sign, words are
cut there: no lattice path is lost, and "cat," and "cat." share their longest
part. Characters without a piece, and a literal U+2581, become byte ids, so
decoding gives every text back exactly. Scores are whole millionths, so sums
are exact.

Defined results: a null text has null ids; the empty text has none. Repeated
rows are encoded alike. Of segmentations with the same score the one whose
last piece is longest wins, then so for the piece before it. A part of more
than ``MOST_CHARS`` characters, for which folding an array would be quadratic,
is encoded by the same recursion in Python, with the same result; so is a word
that its unit's file lacks, as when a plan puts other rows into a partition
the second time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import _base, pieces, tokens

MOST_CHARS = 200
CHUNK_IDS = 1 << 18
CHUNK_BYTES = 3 << 20
BROADCAST_PIECES = 1_000_000
#: How many distinct words a unit gathers, and how many go back together, before they are passed on.
HELD_WORDS, PACKED_WORDS = 1_000_000, 200_000
#: An edge in one number: score in millionths, 255 - start (so that the longest piece wins a tie), id; the last id stands for a character without a piece.
START_BIT, SCORE_BIT = 20, 28
UNKNOWN = (1 << START_BIT) - 1


def micro(logp: float) -> int:
    return round(logp * 1e6)


def viterbi(word: str, vocabulary: pieces.Vocabulary) -> list[int]:
    """Ids of a part; -1 stands for one character without a piece. The fold's results, without its arrays."""
    best = [(0, 0, 0)]
    longest, byte = vocabulary.longest, micro(vocabulary.byte_logp)
    for end in range(1, len(word) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            part = word[start:end]
            id_ = vocabulary.ids.get(part)
            if start and part[0] == pieces.SPACE:
                id_ = None
            if id_ is not None:
                cost = micro(vocabulary.logp[part])
            elif end - start > 1:
                continue
            else:
                id_, cost = -1, byte * len(part.encode())
            score = best[start][0] + cost
            if top is None or score > top[0]:
                top = (score, start, id_)
        best.append(top)
    out, at = [], len(word)
    while at:
        _, at, id_ = best[at]
        out.append(id_)
    return out[::-1]


def spelled(word: str, ids: list[int], vocabulary: pieces.Vocabulary) -> list[int]:
    """Replace -1 by the byte ids of the character at its place."""
    if -1 not in ids:
        return ids
    out, at = [], 0
    for i in ids:
        if i < 0:
            out += [vocabulary.byte_ids[b] for b in word[at].encode()]
            at += 1
        else:
            out.append(i)
            at += len(vocabulary.texts[i].decode())
    return out


def parts(words: pa.Array, cut: bool) -> tuple[pa.Array, np.ndarray]:
    """Parts of words without their spaces, one word's after another, and where each word's begin; first parts have the mark.

    With ``cut`` words are cut between letters and other characters, but for
    those that hold the mark, or NUL, which separates parts here.
    """
    n = len(words)
    whole = pc.utf8_is_alpha(words)
    if cut:
        whole = pc.or_(whole, pc.match_substring_regex(words, f"[{pieces.SPACE}\\x00]"))
        odd = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        some = words.take(pa.array(odd))
        some = pc.replace_substring_regex(some, r"([\pL\pM])([^\pL\pM])", "\\1\x00\\2")
        some = pc.replace_substring_regex(some, r"([^\pL\pM\x00])([\pL\pM])", "\\1\x00\\2")
        lists = pc.split_pattern(some, "\x00")
        counts = np.ones(n, np.int64)
        counts[odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(counts)])
        # flat: whole words first, then the parts of the others, brought into order
        order = np.empty(int(starts[-1]), np.int64)
        rest = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        order[starts[rest]] = np.arange(len(rest))
        order[tokens.ragged(starts[odd], counts[odd])] = len(rest) + np.arange(int(counts[odd].sum()))
        flat = pa.concat_arrays([words.take(pa.array(rest)), lists.flatten()]).take(pa.array(order))
    else:
        flat, starts = words, np.arange(n + 1)
    first = np.zeros(len(flat), bool)
    first[starts[:-1]] = True
    return pc.binary_join_element_wise(pc.if_else(pa.array(first), pieces.SPACE, ""), flat, ""), starts


def piece_table(words: DataFrame, vocabulary: pieces.Vocabulary) -> DataFrame:
    """(piece, edge, h): each piece's score and id, to be broadcast."""
    if pieces.SPACE not in vocabulary.ids:
        raise ValueError("the vocabulary needs the space mark as a piece")
    if len(vocabulary.ids) > BROADCAST_PIECES or max(vocabulary.ids.values()) >= UNKNOWN:
        raise ValueError("a vocabulary of over a million pieces")
    lowest = min(4 * vocabulary.byte_logp, min(vocabulary.logp.values()))
    if MOST_CHARS * max(abs(lowest), *map(abs, vocabulary.logp.values())) >= 34_000:
        raise ValueError("scores out of range")
    rows = [(p, (micro(vocabulary.logp[p]) << SCORE_BIT) | i) for p, i in vocabulary.ids.items()]
    return F.broadcast(words.sparkSession.createDataFrame(rows, "piece string, edge long").withColumn("h", F.xxhash64("piece")))


def _by_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group edges (word, units, e, x) by word and end; a word's edges follow each other, and only its first has word and units."""
    held = None
    for batch in batches:
        edges = pa.Table.from_batches([batch] if held is None else [*held, batch])
        begin = np.flatnonzero(edges["word"].is_valid().to_numpy())
        at = int(begin[-1])
        if at:
            yield _grouped(edges.slice(0, at), begin[:-1])
        held = edges.slice(at).to_batches()
    if held:
        yield _grouped(pa.Table.from_batches(held), np.zeros(1, np.int64))
    _base.trim()


def _grouped(edges: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
    n = edges.num_rows
    key = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n))) * 256 + edges["e"].to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = pa.ListArray.from_arrays(pa.array(np.append(new, n).astype(np.int32)), pa.array(edges["x"].to_numpy()[order]))
    per = np.bincount(key[new] >> 8, minlength=len(begin))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), ends)
    firsts = edges.select(["word", "units"]).take(pa.array(begin)).combine_chunks()
    return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) for c in firsts.columns), lists], ["word", "units", "ends"])


def encode_words(words: DataFrame, vocabulary: pieces.Vocabulary) -> DataFrame:
    """(word, units, ids) for distinct parts (word, units) of 1 to MOST_CHARS characters; -1 stands for a character without a piece."""
    longest = vocabulary.longest
    table = piece_table(words, vocabulary)
    # every place and size: whole numbers are exploded, strings are cut afterwards, all in generated code
    cut = words.select("word", "units", F.explode(F.expr(f"sequence(0, length(word) * {longest} - 1)")).alias("i"))
    cut = cut.select("word", "units", F.expr(f"cast(i div {longest} as int)").alias("s"), F.expr(f"i % {longest} + 1").alias("n")).where("s + n <= length(word)")
    cut = cut.withColumn("sub", F.expr("substring(word, s + 1, n)")).withColumn("hash", F.xxhash64("sub"))
    # pieces are met by a hash of 64 bits and then compared
    joined = cut.join(table, cut.hash == table.h, "left")
    known = F.col("edge").isNotNull() & (F.col("piece") == F.col("sub")) & ~((F.col("s") > 0) & F.col("sub").startswith(pieces.SPACE))
    spelt = F.shiftleft(F.octet_length("sub").cast("long") * micro(vocabulary.byte_logp), SCORE_BIT) + UNKNOWN
    first = (F.col("s") == 0) & (F.col("n") == 1)
    # Generate and a broadcast join keep the order of rows, so a word's edges stay together
    edges = joined.where(known | (F.col("n") == 1)).select(
        F.when(first, F.col("word")).alias("word"), F.when(first, F.col("units")).alias("units"), (F.col("s") + F.col("n")).alias("e"),
        (F.when(known, F.col("edge")).otherwise(spelt) + F.shiftleft((255 - F.col("s")).cast("long"), START_BIT)).alias("x"),
    )
    grouped = edges.mapInArrow(_by_end, "word string, units array<int>, ends array<array<bigint>>")
    # best[e]: the best edge that ends at e, its score that of the whole way
    fold = f"""aggregate(ends, array(0L), (best, es) -> concat(best, array(array_max(transform(es, x ->
        x + shiftleft(shiftright(best[255 - cast(shiftright(x, {START_BIT}) & 255 AS int)], {SCORE_BIT}), {SCORE_BIT}))))))"""
    back = f"""aggregate(reverse(sequence(1, size(best) - 1)), struct(size(best) - 1 AS at, array() :: array<int> AS ids), (a, e) ->
        IF(e = a.at, struct(255 - cast(shiftright(best[e], {START_BIT}) & 255 AS int) AS at,
          concat(array(IF(best[e] & {UNKNOWN} = {UNKNOWN}, -1, cast(best[e] & {UNKNOWN} AS int))), a.ids) AS ids), a), a -> a.ids)"""
    return grouped.select("word", "units", F.expr(fold).alias("best")).select("word", "units", F.expr(back).alias("ids"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, words, ids) of (word, units, ids): what goes back to a unit from here, in blocks, as compressed Arrow arrays."""
    held, n = [], 0

    def passed() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        units = pa.concat_arrays(whole["units"].chunks)
        owner = np.repeat(np.arange(len(units)), pc.list_value_length(units).to_numpy(zero_copy_only=False))
        unit = units.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(unit, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(unit[order]) != 0))
        some = whole.select(["word", "ids"])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(some.take(pa.array(owner[order[a:b]])).combine_chunks())
            yield pa.record_batch([pa.array([unit[order[a]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["unit", "words"])

    for batch in batches:
        held.append(batch)
        n += len(batch.column("units").flatten())
        if n > PACKED_WORDS:
            yield from passed()
            held, n = [], 0
    if n:
        yield from passed()
    held.clear()
    _base.trim()


def _listed(cut: bool):
    """The first pass: (unit, word) for the distinct parts of a partition's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId()
        held: set[str] = set()

        def passed() -> Iterator[pa.RecordBatch]:
            words = pa.array(list(held), pa.string())
            for i in range(0, len(words), 100_000):
                some = words.slice(i, 100_000)
                yield pa.record_batch([pa.array(np.full(len(some), unit, np.int32)), some], names=["unit", "word"])
            held.clear()

        for batch in batches:
            for texts in _base.chunks(batch.column("text"), CHUNK_BYTES):
                found = pc.unique(parts(_base.by_space(texts).unique, cut)[0])
                held.update(found.filter(pc.less_equal(pc.utf8_length(found), MOST_CHARS)).to_pylist())
                if len(held) > HELD_WORDS:
                    yield from passed()
        yield from passed()
        _base.trim()

    return run


class _Looked:
    """A unit's words: where their ids are in one array."""

    def __init__(self, words: pa.Array, lists: pa.Array, voc: pieces.Vocabulary):
        self.words, self.voc = words, voc
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        self.length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.length) - self.length
        odd = np.unique(np.searchsorted(np.cumsum(self.length), np.flatnonzero(flat < 0), side="right")) if len(flat) else []
        more, at = [], len(flat)
        for i in odd:
            a = self.first[i]
            ids = np.array(spelled(words[int(i)].as_py(), flat[a : a + self.length[i]].tolist(), voc), np.int32)
            more.append(ids)
            self.first[i], self.length[i] = at, len(ids)
            at += len(ids)
        self.flat = np.concatenate([flat, *more])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and each text's number of ids."""
        words = _base.by_space(texts)
        flat, starts = parts(words.unique, self.voc.cut)
        slot = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missed = np.flatnonzero(slot < 0)
        extra = [np.array(spelled(w, viterbi(w, self.voc), self.voc), np.int32) for w in flat.take(pa.array(missed)).to_pylist()]
        pool = np.concatenate([self.flat, *extra])
        first = np.append(self.first, 0)[slot]
        length = np.append(self.length, 0)[slot]
        extra_n = np.fromiter(map(len, extra), np.int64, len(extra))
        first[missed], length[missed] = len(self.flat) + np.cumsum(extra_n) - extra_n, extra_n
        # ids by word, then by token
        pool = pool[tokens.ragged(first, length)]
        upto = np.concatenate([[0], np.cumsum(length)])
        first, length = upto[starts[:-1]], upto[starts[1:]] - upto[starts[:-1]]
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        live = ~empty[words.owner()]
        chosen = words.index[live]
        return pool[tokens.ragged(first[chosen], length[chosen])], np.bincount(words.owner()[live], weights=length[chosen], minlength=len(texts)).astype(np.int64)


def _unit_words(folder: str, unit: int) -> tuple[pa.Array, pa.Array]:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    found = system.get_file_info(fs.FileSelector(f"{path}/unit={unit}", allow_not_found=True))
    blobs = [x for f in found if f.path.endswith(".parquet") for x in pq.ParquetFile(system.open_input_file(f.path)).read(columns=["words"])["words"].to_pylist()]
    if not blobs:
        return pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
    whole = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs])
    return pa.concat_arrays(whole["word"].chunks), pa.concat_arrays(whole["ids"].chunks)


def encode(docs: DataFrame, directory: str = _base.TOKENIZER_DIR, name: str = pieces.PIECE_FILE, vocabulary: pieces.Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, ids) for each row. The words are encoded at once, the rows when the result is computed.

    With ``back`` there is a column ``text`` too: the ids decoded again, as decode does, without a second Python worker for each task.
    """
    voc = vocabulary or pieces.load(directory, name)
    d = _base.pick(docs, doc_id=id_col, text=text_col)
    folder = _base.new_path(d.sparkSession, "unit_words")
    # a number is given, as words are small but cost much: adaptive execution would bring them together by their bytes
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = d.mapInArrow(_listed(voc.cut), "unit int, word string").repartition(n, "word").groupBy("word").agg(F.collect_list("unit").alias("units"))
    encode_words(words, voc).mapInArrow(_packed, "unit int, words binary").repartition("unit").write.partitionBy("unit").parquet(folder)
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("text", T.StringType())] if back else [])])
    spelt = _spellings(voc)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or _Looked(*_unit_words(folder, TaskContext.get().partitionId()), voc)
            at = 0
            for texts in _base.chunks(batch.column("text"), CHUNK_BYTES):
                ids, n = known.encode(texts)
                rows = batch.slice(at, len(texts))
                at += len(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(rows.column("text").is_null().to_numpy(zero_copy_only=False), False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.record_batch([rows.column("doc_id"), lists, *([_decode(lists, *spelt)] if back else [])], names=schema.names)
        known = None
        _base.trim()

    return d.mapInArrow(look_up, schema)


def decode_ids(lists: pa.Array, voc: pieces.Vocabulary) -> pa.Array:
    """Each list's text, without the space of its first word; null for null. Bytes that aren't UTF-8 are replaced."""
    return _decode(lists, *_spellings(voc))


def _spellings(voc: pieces.Vocabulary) -> tuple[bytes, np.ndarray]:
    return b"".join(voc.texts), np.fromiter(map(len, voc.texts), np.int64, len(voc.texts))


def _decode(lists: pa.Array, spelt: bytes, size: np.ndarray) -> pa.Array:
    first = np.cumsum(size) - size
    pool = np.frombuffer(spelt, np.uint8)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    texts: list[str | None] = []
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_IDS, side="right")))
        part = lists.slice(at, to - at)
        ids = part.flatten().to_numpy(zero_copy_only=False)
        whole = pool[tokens.ragged(first[ids], size[ids])].tobytes()
        upto = np.concatenate([[0], np.cumsum(size[ids])])
        stops = upto[np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))].tolist()
        for start, stop, valid in zip([0, *stops], stops, part.is_valid().to_pylist()):
            texts.append(whole[start:stop].decode("utf-8", "replace")[1:] if valid else None)
        at = to
    return pa.array(texts, pa.string())


def decoded(ids: Column | str, directory: str = _base.TOKENIZER_DIR, name: str = pieces.PIECE_FILE, vocabulary: pieces.Vocabulary | None = None) -> Column:
    # workers get the pieces' bytes alone: reading the file in each would take many times as much memory
    spelt = _spellings(vocabulary or pieces.load(directory, name))

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        return _decode(lists, *spelt)

    return run(ids)


def decode(encoded: DataFrame, directory: str = _base.TOKENIZER_DIR, name: str = pieces.PIECE_FILE, vocabulary: pieces.Vocabulary | None = None, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids, text) for each row: null ids give a null text."""
    d = _base.pick(encoded, doc_id=id_col, ids=ids_col)
    return d.select("doc_id", "ids", decoded("ids", directory, name, vocabulary).alias("text"))
