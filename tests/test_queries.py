"""Every query with SQL agrees with it; every other runs and has columns."""

import pytest

from oracle import rows_of, sql_rows, view_connection

from evigraph.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, name):
    got, cols = rows_of(catalogue.queries()[name](spark, small))
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want, names = sql_rows(view_connection(small), sql)
        assert cols == names
        assert got == want
    else:
        assert cols
