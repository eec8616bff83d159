"""Times the headline queries: one JSON line. Index build and queries apart; each figure is the median of five warm runs, or of as many as a minute holds."""

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from quillon import queries  # noqa: E402

WARM = ("term_count", "bool_and_not", "bm25_topk", "bm25_or_topk", "bm25_and_topk", "block_max_topk", "external_filter", "topk_and_count", "rrf_two_lists", "bm25_wide_or_topk")
WHOLE = ("postings_build", "normalize_terms")
RUNS, SECONDS = 5, 60


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))  # one machine: its own folder is one that all share
    spark = builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = {}

    def timed(name: str, f) -> None:
        began = time.perf_counter()
        f()
        out.setdefault(name, []).append(time.perf_counter() - began)

    def repeated(name: str, f) -> None:
        timed(name, f)
        began = time.perf_counter()
        timed(name, f)
        while len(out[name]) <= RUNS and time.perf_counter() - began < SECONDS:
            timed(name, f)

    def built() -> None:
        queries.forget(spark, sf_dir)
        queries.index_of(spark, sf_dir)

    repeated("index_build", built)
    for name in WHOLE:
        repeated(name, lambda: queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    for name in WARM:
        repeated(name, lambda: queries.QUERIES[name](spark, sf_dir).collect())
    out = {k: v[1:] for k, v in out.items()}  # the first run of each is cold
    seconds = {k: round(statistics.median(v), 3) for k, v in out.items()}
    print(json.dumps({"metric": "retrieval_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"), "master": spark.sparkContext.master, "shuffle_partitions": int(cpus)}))


if __name__ == "__main__":
    main()
