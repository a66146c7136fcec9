"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import pytest

from tidewell import catalog, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert catalog.queries()[name](spark, SF).count() > 0
    else:
        assert compare.difference(spark, SF, catalog.queries()[name], sql) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
