"""Every registered query against its SQL counterpart on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = _rows(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    assert got == want
    assert got


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
