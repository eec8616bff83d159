"""Token ids as Arrow files of equal-length sequences.

Each partition becomes one file in Arrow's IPC file format. A record batch has
``ids`` (uint16 or int32) and ``mask`` (uint8), both fixed-size lists; all but
the last batch have the same number of rows, so sequence r is row r % rows of
batch r // rows, and a memory-mapped file gives it without copying. Documents
follow each other, each ended by ``end_id``, across sequences; the last
sequence is padded, and its mask is 0 there.

The result is an index: (doc_id, file, start, n_tokens), start counting ids from
the file's beginning, end_id excluded from n_tokens.

A file is written beside its name and then moved there, so a task that is run
again, after an executor is lost or as a second attempt, gives the same file.
``write`` does its work at once and stores the index in folder "index" beside
the files: reading the result again never touches them. The folder may be on
any file system that Arrow reads; files are mapped where it is a local one, and
else read batch by batch.

Defined results: null and empty texts have 0 tokens and still an end_id.
Repeated rows are stored as often as they come. An empty partition has no file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm import _base, tokens

END_ID = 50256


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Writer:
    """Collects ids and writes full batches; ``ids`` may span sequences and batches."""

    def __init__(self, sink, length: int, rows: int, dtype=np.uint16):
        self.length, self.rows, self.dtype = length, rows, dtype
        value = pa.uint16() if dtype == np.uint16 else pa.int32()
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n += len(ids)
        full = self.rows * self.length
        if self.n >= full:
            flat = np.concatenate(self.held)
            while len(flat) >= full:
                self._write(flat[:full], full)
                flat = flat[full:]
            self.held, self.n = [flat], len(flat)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), np.uint8)
        mask[:real] = 1
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            ids = np.concatenate(self.held)
            self._write(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.dtype)]), len(ids))
        self.out.close()


class Sequences:
    """Random access to a file: ``ids(r)`` and ``mask(r)`` are views of the mapped file."""

    def __init__(self, path: str):
        local = path.removeprefix("file://")
        system, place = _open(path)
        self.file = pa.ipc.open_file(pa.memory_map(local) if "://" not in local else system.open_input_file(place))
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        last = self.file.get_batch(self.file.num_record_batches - 1).num_rows if self.file.num_record_batches else 0
        self.count = self.rows * max(0, self.file.num_record_batches - 1) + last

    def _row(self, r: int, column: int) -> np.ndarray:
        lists = self.file.get_batch(r // self.rows).column(column)
        size = lists.type.list_size
        return lists.values.to_numpy(zero_copy_only=True)[(r % self.rows) * size : (r % self.rows + 1) * size]

    def ids(self, r: int) -> np.ndarray:
        return self._row(r, 0)

    def mask(self, r: int) -> np.ndarray:
        return self._row(r, 1)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from position ``start`` of the file; across sequences this copies."""
        if not n:
            return np.zeros(0, np.int64)
        length = self.file.schema.field("ids").type.list_size
        rows = range(start // length, (start + n - 1) // length + 1)
        return np.concatenate([self.ids(r) for r in rows])[start % length : start % length + n]


def write(docs: DataFrame, path: str, length: int = 1024, rows: int = 1024, directory: str = _base.TOKENIZER_DIR, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of the files, which are written in the new folder ``path``."""
    d = _base.pick(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, folder = _open(path)
        name = f"part-{task.partitionId():06d}.arrow"
        draft = f"{folder}/.{name}.{task.taskAttemptId()}"
        sink = writer = None
        position = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(folder, recursive=True)
                sink = system.open_output_stream(draft)
                writer = Writer(sink, length, rows, np.uint16 if end_id < 65536 else np.int32)
            counts = []
            for part in _base.chunks(batch.column("text")):
                ids, n = tokens.byte_bpe(directory).encode(part)
                ends = np.cumsum(n)
                writer.add(np.insert(ids, ends, end_id))
                counts.append(n)
            n = np.concatenate(counts)
            start = position + np.cumsum(n + 1) - (n + 1)
            position += int((n + 1).sum())
            yield pa.record_batch([batch.column("doc_id"), pa.array([f"{path}/{name}"] * len(n)), pa.array(start), pa.array(n)], names=["doc_id", "file", "start", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()
            system.move(draft, f"{folder}/{name}")

    d.mapInArrow(run, schema).write.parquet(f"{path}/index")
    return d.sparkSession.read.schema(schema).parquet(f"{path}/index")
