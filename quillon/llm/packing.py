"""Hierarchical multi-length packing.

A document of n tokens goes to the smallest context size (tier) that holds it.
One that is longer than the largest is cut into whole windows of that size, and
what is left is routed like a document. Each tier is packed best-fit
decreasing. Then the windows of the longest tier, and of each shorter one in
turn, take pieces from the tiers below into the gaps they have left, largest
pieces first; what is taken is not packed below. A tier's windows, of all shards
together, are dealt to step groups of ``group`` windows (one or a few less in
some), the fullest first, so that groups hold like numbers of tokens.

Lengths are numbers of ids of the byte BPE (``token_lengths``), or bytes: see pack.
Only ids and lengths are shuffled. Shards of about ``shard_docs`` documents are
packed apart; their number follows the number of documents.

Defined results: null and empty texts have no tokens and no rows. Repeated rows
are packed as often as they come, told apart by ``copy``; so are texts of equal
length under one id, and those of other lengths by ``doc_tokens``. Null ids
are an id. Equal lengths go by id (as a string), copy and start. An empty
table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm import _base, tokens

TIERS = (2048, 8192, 32768)
BLOCK = 1024


def route(length: int, tiers: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(tier, start, n) of the pieces of a document."""
    top = tiers[-1]
    out = [(len(tiers) - 1, i * top, top) for i in range(length // top)] if length > top else []
    start = top * len(out)
    if n := length - start:
        out.append((bisect.bisect_left(tiers, n), start, n))
    return out


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Windows of indices into ``lengths``, which must be decreasing; each goes to the fullest window that holds it, the oldest of those."""
    windows: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(gaps, (n, -1))
        if at < len(gaps):
            gap, w = gaps.pop(at)
            windows[w].append(i)
        else:
            gap, w = size, len(windows)
            windows.append([i])
        if gap > n:
            bisect.insort(gaps, (gap - n, w))
    return windows


def fill(gap: int, keys: list[tuple[int, int]]) -> list[int]:
    """Take pieces, largest first, while they fit; ``keys`` is the sorted list of (length, place) left, and shrinks."""
    took = []
    while keys:
        at = bisect.bisect_right(keys, (gap, 1 << 62)) - 1
        if at < 0:
            break
        # the last place among equal lengths is the last in order: take the first one instead
        n = keys[at][0]
        at = bisect.bisect_left(keys, (n, -1))
        took.append(keys.pop(at)[1])
        gap -= n
    return took


def pack_shard(docs: list[tuple], tiers: tuple[int, ...]) -> list[tuple]:
    """(tier, window, place, doc, start, n, offset) for documents (doc, length), in a fixed order."""
    pieces: dict[int, list[tuple]] = defaultdict(list)
    for order, (doc, length) in enumerate(docs):
        for tier, start, n in route(length, tiers):
            pieces[tier].append((-n, order, start, doc, n))
    left = {t: sorted(p) for t, p in pieces.items()}
    rows = []
    for tier in range(len(tiers) - 1, -1, -1):
        own = left.get(tier, [])
        windows = [[own[i] for i in w] for w in best_fit([p[4] for p in own], tiers[tier])]
        for below in range(tier - 1, -1, -1):
            there = left.get(below, [])
            keys = sorted((p[4], i) for i, p in enumerate(there))
            gone: set[int] = set()
            for w in windows:
                gap = tiers[tier] - sum(p[4] for p in w)
                if gap > 0 and keys:
                    took = fill(gap, keys)
                    w += [there[i] for i in took]
                    gone.update(took)
            left[below] = [p for i, p in enumerate(there) if i not in gone]
        for w, held in enumerate(windows):
            offset = 0
            for place, (_, _, start, doc, n) in enumerate(held):
                rows.append((tier, w, place, doc, start, n, offset))
                offset += n
    return rows


def dealt(windows: DataFrame, group: int) -> DataFrame:
    """(context, shard, window, step_group) of windows (context, shard, window, fill): the fullest first, to and fro over the groups of a context.

    Windows are stored by range, so that each range's number of windows gives
    the ranks of the next, and no task sees all windows.
    """
    order = [F.col("context"), F.desc("fill"), F.col("shard"), F.col("window")]
    ranged = _base.materialize(windows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "windows")
    counts = ranged.groupBy("context", "range").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("context")
    counts = counts.select("context", "range", (F.sum("c").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.ceil(F.sum("c").over(by) / group).cast("long").alias("groups"))
    rank = F.row_number().over(Window.partitionBy("context", "range").orderBy(*order)) - 1 + F.col("before")
    ranked = ranged.join(counts, ["context", "range"]).withColumn("rank", rank)
    at, lap = F.col("rank") % F.col("groups"), F.floor(F.col("rank") / F.col("groups"))
    return ranked.select("context", "shard", "window", F.when(lap % 2 == 0, at).otherwise(F.col("groups") - 1 - at).cast("long").alias("step_group"))


def token_lengths(text: Column | str = "text", directory: str = _base.TOKENIZER_DIR, name: str = tokens.BPE_FILE) -> Column:
    """Each whole text's number of byte BPE ids; a null text has none."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        counts = [tokens.byte_bpe(directory, name).encode(part)[1] for part in _base.chunks(texts)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))

    return run(text)


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, group: int = 8, shard_docs: int = 20_000, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(context, shard, window, place, step_group, doc_id, doc_tokens, copy, start, n_tokens, offset).

    ``length`` gives the number of tokens of column ``text``, such as token_lengths("text"); the default counts bytes, for a byte-level model.
    """
    if list(tiers) != sorted(set(tiers)) or tiers[0] < 1:
        raise ValueError("tiers must be positive and increasing")
    d = _base.pick(docs, doc_id=id_col, text=text_col)
    n = F.octet_length("text") if length is None else length
    # a filter before the table is written would compute the lengths twice
    d = _base.materialize(d.select("doc_id", n.cast("long").alias("n")), "lengths").where("n > 0")
    shards = max(1, -(-d.count() // shard_docs))
    # equal rows are counted, and shared out in blocks: no id, null included, is more than a block to a shard
    d = d.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("times")).select("doc_id", "n", "times", F.explode(F.expr(f"sequence(0L, (times - 1) div {BLOCK})")).alias("block"))
    first = F.col("block") * BLOCK
    d = d.select("doc_id", "n", first.alias("first"), F.least(F.lit(BLOCK), F.col("times") - first).alias("times"), F.pmod(F.xxhash64(F.lit(5), "doc_id", "n", "block"), F.lit(shards)).alias("shard"))
    kind = d.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("context", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("window", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField("doc_id", kind), T.StructField("doc_tokens", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("offset", T.LongType()),
    ])
    integral = isinstance(kind, T.IntegralType)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(x) else int(x) if integral else x for x in part["doc_id"]]
        listed = sorted(zip(ids, part["n"].tolist(), part["first"].tolist(), part["times"].tolist()), key=lambda x: (x[0] is not None, str(x[0]), x[1:]))
        rows = pack_shard([((doc, n, first + i), n) for doc, n, first, times in listed for i in range(times)], tiers)
        out = pd.DataFrame([(tiers[t], int(part["shard"].iloc[0]), w, p, *x, s, m, o) for t, w, p, x, s, m, o in rows], columns=schema.names)
        if integral:
            out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    packed = _base.materialize(d.groupBy("shard").applyInPandas(run, schema), "packed")
    steps = dealt(packed.groupBy("context", "shard", "window").agg(F.sum("n_tokens").alias("fill")), group)
    return packed.join(steps, ["context", "shard", "window"]).select("context", "shard", "window", "place", "step_group", *schema.names[4:])
