"""Every named query against its SQL; TEST_SF_DIR chooses the data."""

import pytest

from tablescout.plans import catalog

from .oracle import compare, connect

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_table(spark, sf_dir, con, name):
    difference = compare(catalog.queries()[name](spark, sf_dir), con, SQL[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_rows_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows[-1]["row_kind"] == "grand"
    assert len(entry.queries()) >= len(entry.oracle_sql())
