"""The corpus operators' registered queries against DuckDB's answers to their SQL."""

import os

import duckdb
import pytest

from dupeloom.llm import queries


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = queries.QUERIES[name](spark, sf_dir)
    wanted = tables.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in df.columns]
    rows = sorted((tuple(r[i] for i in places) for r in wanted.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == rows and rows


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_plans_of_native_scans_run_no_python(spark, sf_dir):
    for name in ("op2_secret_scan", "op4_license_scan"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange", "Join"))
