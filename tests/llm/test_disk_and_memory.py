"""What intermediate steps leave on disk and in the driver."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import _base, exact_dedup, lang_id, near_dedup


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_materialize_leaves_no_shuffles(spark):
    before, conf = shuffle_files(spark), spark.conf.get(_base.SHUFFLE_CLEANUP)
    d = _base.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert sorted(r["count"] for r in d.collect()) == [142] * 1 + [143] * 6
    assert not shuffle_files(spark) - before
    assert spark.conf.get(_base.SHUFFLE_CLEANUP) == conf


def test_passes_hold_every_key():
    prints = np.random.default_rng(5).integers(0, 1 << 62, (50, 4)).astype(np.uint64)
    for first in (True, False):
        every = near_dedup.list_keys(prints, first)[0]
        parts = [near_dedup.list_keys(prints, first, of)[0] for of in near_dedup.PASSES]
        assert sorted(np.concatenate(parts).tolist()) == sorted(every.tolist())
        assert max(map(len, parts)) < len(every) / 5


def test_texts_are_shuffled_once_to_keep_one(spark):
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id long, text string")
    for keep in (exact_dedup.keep_one, near_dedup.keep_one):
        kept = keep(docs)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == 1, plan


@pytest.mark.parametrize("size", [lang_id.TRAIN_BYTES, 4 << 20])
def test_language_training_in_parts(spark, size, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(map("".join, rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (1000, 6)))), "en") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(lang_id, "TRAIN_BYTES", size)
    freed = []
    monkeypatch.setattr(_base, "trim", lambda: freed.append(1))
    tracemalloc.start()
    try:
        model = lang_id.train(d)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.langs == ("en",) and freed
    assert (peak < 60e6) == (size < 1 << 20), peak
