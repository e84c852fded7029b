"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


def whole(column):
    """Whole numbers with nulls among them come as floats from one engine and as integers from the other."""
    if pd.api.types.is_float_dtype(column) and (column.dropna() % 1 == 0).all():
        return column.map(lambda x: "null" if pd.isna(x) else str(int(x)))
    return column


def rows_of(frame):
    frame = frame[sorted(frame.columns)].apply(whole)
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(name, spark, sf_dir, duck):
    result = contract.queries()[name](spark, sf_dir).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(result) > 0
        return
    expected = duck.execute(sql).df()
    assert sorted(result.columns) == sorted(expected.columns)
    assert rows_of(result) == rows_of(expected)


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
