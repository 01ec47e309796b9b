"""Every registered query of the reference's operators against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from spindle.operators import tpch


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf}/{name}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if pd.isna(v):
            return None
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return float(v)

    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(tpch.QUERIES))
def test_query(name, spark, sf, duck):
    got, want = tpch.QUERIES[name](spark, sf).toPandas(), duck.sql(tpch.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark, sf):
    df = tpch.QUERIES["filter_in"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [In(o_orderpriority" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan
    bucketed = tpch.QUERIES["join_bucketed"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in bucketed
