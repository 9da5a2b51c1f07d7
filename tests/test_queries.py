import os

import pytest

from lexspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, compare, name):
    query, sql = catalogue.queries()[name], catalogue.oracle_sql().get(name)
    if sql:
        got, want = compare(spark, query, sql, SF)
        assert got == want
    else:
        assert query(spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.queries()) <= set(e.queries())
