"""Where intermediate tables go: the folder of spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="quillon-")


def shared_path(spark: SparkSession, tag: str) -> str:
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        place = _own_folder(spark.sparkContext.applicationId)
    return f"{place.rstrip('/')}/quillon-{uuid.uuid4().hex}/{tag}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
