"""Every registered query against DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from memloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [list(relation.columns).index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in at) for row in relation.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_what_if_adds_take_no_rows_away(spark, tmp_path):
    """Keys beyond 100,000 meet those of the adds; rows without a key, and keys that repeat."""
    keys = [*range(1, 120), *range(100_000, 100_160), 101, None]
    spark.createDataFrame([(k, f"part {i}") for i, k in enumerate(keys)], "p_partkey long, p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(((r["p_partkey"], r["name"]) for r in QUERIES["t10_what_if"](spark, str(tmp_path)).collect()), key=repr)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(connection.sql(ORACLES["t10_what_if"]).fetchall(), key=repr)
    assert sum(k == 100_101 for k, _ in got) == 3  # its own row and two adds
