"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import check
from raingrid.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries that report what is rare, which the smallest tables may not hold.
MAY_BE_EMPTY = ("linear_trend", "linear_trend_on_year", "linear_trend_p")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    _, notes = check.differences(QUERIES[name](spark, SF), con, SQL[name])
    assert notes == [] or name in MAY_BE_EMPTY and notes == ["no rows"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["series", "ds", "rr", "tavg", "rh", "score", "category", "decision"]
    assert rows.count() > 0
