"""Every query with SQL of its own gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from asofar.queries import ORACLE, QUERIES

from .comparison import of_duckdb, of_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_duckdb(spark, name):
    df = QUERIES[name](spark, SF)
    columns, expected = of_duckdb(ORACLE[name], SF)
    assert sorted(df.columns) == sorted(columns)
    assert of_spark(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
