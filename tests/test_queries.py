"""Every query that has SQL gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon import queries

DIR = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].astype(str).replace({"None": "NULL", "nan": "NULL", "<NA>": "NULL"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{DIR}/{t}')")
    got, want = rows(queries.QUERIES[name](spark, DIR).toPandas()), rows(con.execute(queries.SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
