"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprint: 256 sign bits over a text's distinct lower-case words, each
weighing the square root of its length (of 8 characters at most), so that the
short words that all texts of a language share don't make them alike. The
first 161 bits are seven segments of 23. The binary Golay code [23,12,7] is perfect: every segment is within 3
bits of one codeword, and within 4 bits of one codeword (leader of weight 0 to
2) or six (weight 3). For segments x and y that differ in one bit, the nearest
codeword of y is always among the codewords within 4 of x; often so for two
bits.

Pigeonhole: with up to 11 wrong bits in 161, two of the seven segments have at
most one each. For each of the 21 pairs of segments a key of 24 bits is made
in two roles: codeword list of the first segment with the nearest codeword of
the second, and the other way round. One role is joined to the other, so such
a pair is sure to meet; beyond 11 bits it is likely (see recall in the README).
The keys of three pairs of segments are joined at a time, so that no more than
a seventh of them lies on disk at once, whatever the number of documents.

A key carries the last 128 bits of the fingerprint: a candidate that differs
there in more than ``max_distance`` bits differs in as many of the whole, so it
ends in the join. The others are verified by the Hamming distance of the whole
fingerprints and joined into groups. Documents with the same bag of words are one node from the
start. Stars come before pairs: first every node is held against the least
node of its bucket, and pairs are formed only across the groups so found, so a
group of thousands of near copies costs its size and not its square. No pair
is dropped: two nodes of one group need no edge of their own.

Defined results: a document without words (null, empty, or signs only) and one
with a null id is alone in its group. Repeated rows share a group. group_id is
the least doc_id of the group. Different texts under one id may be in
different groups, which then may have the same group_id. Ids must be of a sortable type.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import _base

SEGMENTS, BITS, WIDTH = 7, 256, 23
MAX_DISTANCE = 40
GENERATOR = 0xAE3
PAIRS = tuple(itertools.combinations(range(SEGMENTS), 2))
PASSES = tuple(PAIRS[i : i + 3] for i in range(0, len(PAIRS), 3))
CHUNK = 1 << 20


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator polynomial."""
    left = np.array(words, np.int64)
    for bit in range(WIDTH - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ GENERATOR << bit - 11, left)
    return left


@functools.lru_cache(maxsize=1)
def error_lists() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome its error patterns of weight at most 4, least weight first, and their number (1 or 6)."""
    patterns = [sum(1 << b for b in at) for w in range(5) for at in itertools.combinations(range(WIDTH), w)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for error, s in zip(patterns, syndrome(np.array(patterns)).tolist()):
        found[s].append(error)
    table = np.zeros((2048, 6), np.int64)
    for s, errors in enumerate(found):
        table[s, : len(errors)] = errors
    return table, np.array([len(x) for x in found])


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (0..4095) of the codewords within 4 bits, nearest first, with how many of the 6 places hold one."""
    table, count = error_lists()
    s = syndrome(words)
    return (words[..., None] ^ table[s]) >> 11, count[s]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n x 4 words of 64 bits, n x 2 hashes of the bag of words, number of words)."""
    prints, bags, sizes = [np.zeros((0, 4), np.uint64)], [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
    for part in _base.chunks(texts, CHUNK):
        words = _base.lower_words(part)
        n, distinct = len(part), len(words.unique)
        key, tf = np.unique(words.owner() * max(1, distinct) + words.index, return_counts=True)
        owner, index = key // max(1, distinct), key % max(1, distinct)
        hashed = pd.util.hash_array(words.unique.to_numpy(zero_copy_only=False), categorize=False) if distinct else np.zeros(0, np.uint64)
        lanes = np.stack([_mix(hashed, i + 1) for i in range(4)], 1)
        signs = np.unpackbits(lanes.view(np.uint8).reshape(distinct, 32), axis=1, bitorder="little").astype(np.float32) * 2 - 1
        total = np.zeros((n, BITS), np.float32)
        starts = np.searchsorted(owner, np.arange(n + 1))
        size = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False)
        weight = np.sqrt(np.minimum(size, 8)).astype(np.float32)[index]
        for i in range(n):
            a, b = starts[i], starts[i + 1]
            if b > a:
                total[i] = _dot(weight[a:b], signs, index[a:b])
        prints.append(np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64))
        bag = np.zeros((n, 2), np.uint64)
        for lane in range(2):
            np.add.at(bag[:, lane], owner, _mix(hashed[index] + tf.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 9 + lane))
        bags.append(bag)
        sizes.append(np.diff(words.starts))
    return np.concatenate(prints), np.concatenate(bags), np.concatenate(sizes)


def _dot(weight: np.ndarray, signs: np.ndarray, index: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.float32)
    for i in range(0, len(index), 4096):
        total += weight[i : i + 4096] @ signs[index[i : i + 4096]]
    return total


def segments(prints: np.ndarray) -> np.ndarray:
    """The seven segments of 23 bits of n x 4 words."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : SEGMENTS * WIDTH].reshape(-1, SEGMENTS, WIDTH)
    return bits.astype(np.int64) @ (1 << np.arange(WIDTH))


def nearest_keys(prints: np.ndarray) -> np.ndarray:
    """n x 21 keys, of the nearest codewords of each pair of segments."""
    index = near_codewords(segments(prints))[0][:, :, 0]
    return np.stack([k << 24 | index[:, i] << 12 | index[:, j] for k, (i, j) in enumerate(PAIRS)], 1)


def list_keys(prints: np.ndarray, first: bool, pairs: tuple[tuple[int, int], ...] = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one role, one document after another, and how many each has: the codeword list of the
    first (or else the second) segment of each of ``pairs`` with the nearest codeword of the other."""
    index, count = near_codewords(segments(prints))
    held = np.arange(6) < count[:, :, None]
    keys, ok = [], []
    for i, j in pairs:
        one, other = (index[:, i], index[:, j, :1]) if first else (index[:, i, :1], index[:, j])
        keys.append(PAIRS.index((i, j)) << 24 | one << 12 | other)
        ok.append(held[:, i if first else j])
    keys, ok = np.concatenate(keys, 1), np.concatenate(ok, 1)
    return keys[ok], ok.sum(1)


PRINT = "struct<a:bigint,b:bigint,c:bigint,d:bigint,bag1:bigint,bag2:bigint,n:bigint>"


def fingerprint(text: Column | str) -> Column:
    """Fingerprint (a..d), hashes of the bag of words, number of words."""

    @F.arrow_udf(PRINT)
    def run(texts: pa.Array) -> pa.Array:
        prints, bags, n = fingerprints(texts)
        lanes = [*prints.T, *bags.T]
        return pa.StructArray.from_arrays([*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in lanes), pa.array(n)], ["a", "b", "c", "d", "bag1", "bag2", "n"])

    return run(text)


def _prints(columns: tuple[pa.Array, ...]) -> np.ndarray:
    return np.stack([x.to_numpy(zero_copy_only=False).view(np.uint64) for x in columns], 1).copy()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _nearest(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
    keys = nearest_keys(_prints((a, b, c, d))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * len(PAIRS)), pa.array(keys.ravel()))


def _listed(first: bool, of: tuple[tuple[int, int], ...], *lanes: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        prints = _prints((a, b, c, d))
        keys, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(prints), 4096):
            k, n = list_keys(prints[i : i + 4096], first, of)
            keys.append(k.astype(np.int32))
            counts.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(keys)))

    return run(*lanes)


def _verified(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Pairs (x, y) whose fingerprints differ in at most ``most`` bits."""
    side = lambda n: nodes.select(F.col("gid").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "abcd"])
    joined = pairs.join(side("x"), "x").join(side("y"), "y")
    distance = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in "abcd"), F.lit(0))
    return joined.where(distance <= most).select("x", "y")


def _meeting(seen: DataFrame, of: tuple[tuple[int, int], ...], most: int) -> DataFrame:
    """Pairs (x, y) of different groups that share a key of the pairs of segments ``of`` and differ in at most ``most`` of the check bits."""
    lanes = [F.col(c) for c in "abcd"]
    role = lambda first, n: seen.select(F.col("gid").alias(n), F.col("root").alias(f"r{n}"), F.col("c").alias(f"c{n}"), F.col("d").alias(f"d{n}"), F.explode(_listed(first, of, *lanes)).alias("key"))
    apart = F.coalesce("rx", "x") != F.coalesce("ry", "y")
    close = F.bit_count(F.col("cx").bitwiseXOR(F.col("cy"))) + F.bit_count(F.col("dx").bitwiseXOR(F.col("dy"))) <= most
    # what has the keys grows with the corpus, so it is sorted at every size
    return role(True, "x").join(role(False, "y").hint("merge"), "key").where(apart & close).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (x, y) edges; root is the least node that it is connected to.

    Edges are contracted: each round every node points to its least neighbour,
    chains of pointers are halved, and edges are rewritten to the roots.
    Each round is a table in the shared folder, so a lost executor costs no more than the round.
    """
    edges = _base.materialize(edges.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    both = edges.union(edges.select("y", "x"))
    tree = _base.materialize(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("root")), "tree")
    while True:
        roots = tree.select(F.col("node").alias("n"), F.col("root").alias("r"))
        # where an edge's ends have different roots, the greater root learns of the lesser
        at = edges.join(roots.toDF("x", "rx"), "x").join(roots.toDF("y", "ry"), "y").where("rx != ry")
        learnt = at.select(F.greatest("rx", "ry").alias("n"), F.least("rx", "ry").alias("r")).groupBy("n").agg(F.min("r").alias("r2"))
        tree2 = tree.join(learnt, tree.node == learnt.n, "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"))
        tree2 = _base.materialize(tree2, "tree")
        up = tree2.select(F.col("node").alias("n"), F.col("root").alias("r3"))
        tree3 = _base.materialize(tree2.join(up, tree2.root == up.n, "left").select("node", F.least("root", F.coalesce("r3", "root")).alias("root")), "tree")
        old = tree.select(F.col("node").alias("n"), F.col("root").alias("o"))
        done = tree3.join(old, tree3.node == old.n).where("root != o").isEmpty()
        _base.discard(tree)
        _base.discard(tree2)
        if done:
            _base.discard(edges)
            return tree3
        tree = tree3


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) for each row."""
    d = _base.pick(docs, doc_id=id_col, text=text_col)
    return _grouped(d, max_distance).select("doc_id", "group_id")


def _grouped(d: DataFrame, max_distance: int) -> DataFrame:
    """(doc_id, h, group_id) for each row of (doc_id, text); h is the text's hash."""
    prints = d.select("doc_id", F.xxhash64("text").alias("h"), fingerprint("text").alias("p")).select("doc_id", "h", "p.*")
    prints = _base.materialize(prints, "prints")
    usable = prints.where("n > 0 and doc_id is not null")
    rest = prints.where("n = 0 or doc_id is null").select("doc_id", "h", F.col("doc_id").alias("group_id"))
    bags = usable.groupBy("bag1", "bag2", "n").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in "abcd"])
    # a doc_id may have several bags, so nodes go by their bag
    nodes = _base.materialize(bags.withColumn("gid", F.xxhash64("bag1", "bag2", "n")), "nodes")
    lanes = [F.col(c) for c in "abcd"]
    near = nodes.select("gid", F.explode(_nearest(*lanes)).alias("key"))
    pivot = near.groupBy("key").agg(F.min("gid").alias("x"))
    stars = near.join(pivot, "key").where("gid != x").select("x", F.col("gid").alias("y")).distinct()
    stars = _base.materialize(_verified(stars, nodes, max_distance), "stars")
    tree = components(stars)
    # a root that the node is itself is left out: zeros take next to no disk
    seen = nodes.join(tree.where("root != node"), nodes.gid == tree.node, "left").select("gid", *lanes, "root")
    seen = _base.materialize(seen, "seen")
    met = [_base.materialize(_meeting(seen, of, max_distance), "met") for of in PASSES]
    pairs = functools.reduce(DataFrame.union, met).distinct()
    tree = components(stars.union(_verified(pairs, nodes, max_distance)))
    rooted = nodes.join(tree, nodes.gid == tree.node, "left").select("bag1", "bag2", "n", "least", F.coalesce("root", "gid").alias("root"))
    rooted = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("group_id")), "root").drop("root", "least")
    return usable.join(rooted, ["bag1", "bag2", "n"]).select("doc_id", "h", "group_id").unionByName(rest)


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those that aren't the least doc_id of their group; rows with a null id stay.

    Rows are told apart by id and text, so of two texts under one id only the duplicate goes.
    """
    found = _grouped(_base.pick(docs, doc_id=id_col, text=text_col), max_distance).where("group_id != doc_id")
    # written first, so that its shuffles and the texts' aren't on disk together; it grows with the corpus, so it is sorted at every size
    dropped = _base.materialize(found.select(F.col("doc_id").alias("dropped__id"), F.col("h").alias("dropped__h")).distinct(), "dropped").hint("merge")
    d, name = _base.plain(docs)
    return d.join(dropped, (d[name(id_col)] == F.col("dropped__id")) & (F.xxhash64(d[name(text_col)]) == F.col("dropped__h")), "left_anti").toDF(*docs.columns)
