"""What the training-data operators share: picking columns by exact name,
writing intermediate tables to the cluster's shared folder, and turning an
Arrow column of texts into word arrays.

Every operator selects just the columns that it names, so extra columns of
the input, whatever they are called, cannot clash with its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_DIR = "/opt/tokenizers"
CHUNK_BYTES = 4 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LIBC = ctypes.CDLL(None)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select input columns by position of their exact name, renamed to the keywords.

    Going by position keeps ``Text`` and ``text``, or a repeated name, from
    being ambiguous; the first exact match wins.
    """
    names = df.columns
    for wanted in columns.values():
        if wanted not in names:
            raise ValueError(f"no column {wanted!r} among {names}")
    plain = df.toDF(*[f"c{i}__" for i in range(len(names))])
    return plain.select(*[plain[f"c{names.index(old)}__"].alias(new) for new, old in columns.items()])


def plain(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with columns named by position, and what each is called there; for results that keep all columns."""
    names = df.columns
    return df.toDF(*[f"c{i}__" for i in range(len(names))]), lambda name: f"c{names.index(name)}__"


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="quillon-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark runs within one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        place = _own_folder(spark.sparkContext.applicationId)
    return place.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}/{tag}"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Executions begun within delete their shuffle files at their end; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends, lost executors don't matter, and its shuffles take no disk any more."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def trim() -> None:
    """Give memory that Arrow and numpy have freed back to the system: idle Python workers would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of at most ``limit`` bytes, or one text; nulls become empty. No text is cut."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield texts.slice(at, to - at)
        at = to


class Words:
    """Texts of a chunk split into words: ``index`` points into ``unique``; ``starts[i]:starts[i+1]`` are text i's."""

    def __init__(self, lists: pa.ListArray):
        flat = lists.flatten().dictionary_encode()
        self.starts = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=self.starts[1:])
        self.index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.unique = flat.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def by_space(texts: pa.Array) -> Words:
    """Split at each U+0020, so that joining with spaces gives the text again."""
    return Words(pc.split_pattern(texts, " "))


def lower_words(texts: pa.Array) -> Words:
    """Lower-case runs of letters and digits."""
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " "), " ")
    lists = pc.split_pattern(spaced, " ")
    words = Words(lists)
    empty = pc.equal(words.unique, "").to_numpy(zero_copy_only=False)
    if empty.any():
        keep = ~empty[words.index]
        owner = words.owner()[keep]
        words.index = words.index[keep]
        words.starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=len(texts)), out=words.starts[1:])
    return words


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values[starts[i]:starts[i+1]]`` for each i; 0 for empty slices. It depends on the slice alone, not on what lies before it."""
    out, some = np.zeros(len(starts) - 1), np.diff(starts) > 0
    if some.any():
        out[some] = np.add.reduceat(np.asarray(values[: starts[-1]], np.float64), starts[:-1][some])
    return out


def codepoints(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All strings' code points one after another, and each string's length."""
    lengths = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = pc.binary_join(pa.array([strings.to_pylist()], pa.list_(pa.string())), "")[0].as_py() if len(strings) else ""
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes without copying, and offsets into them."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]
