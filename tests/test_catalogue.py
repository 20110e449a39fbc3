"""Every query with SQL equals DuckDB on the same tables; the others give rows."""

from __future__ import annotations

import pytest
from compare import differences

from fernwood.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, sf_dir, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 10
    assert set(driver.oracle_sql()) <= set(driver.queries())
