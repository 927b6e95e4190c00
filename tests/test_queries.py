"""Every registered query of the engine against its SQL twin in DuckDB."""

import pytest
from compare import connect, difference

from dqengine import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_twin(spark, con, name):
    assert difference(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
