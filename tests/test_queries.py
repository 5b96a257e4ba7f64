"""Every core query against its SQL; the others for their shape."""

import os

import pytest

from cadastra.plans import record_queries, table_queries
from tests.oracle import DATA, rows_of, sql_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES = {**table_queries.queries(), **record_queries.queries()}
SQL = {**table_queries.oracle_sql(), **record_queries.oracle_sql()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    names, expected = sql_rows(SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() >= 0 and df.columns


def test_entry_has_the_core_queries(spark):
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, capsys):
    table_queries.order_revenue(spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "l_discount" in plan and "l_comment" not in plan
