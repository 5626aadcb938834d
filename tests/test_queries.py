"""Every query that SQL can express gives DuckDB's rows."""

import pytest

from loomgraph import queries as core
from tests.oracle import compare, duck


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_equals_sql(spark, con, sf, name):
    compare(spark, con, name, core.QUERIES[name], core.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    assert core.QUERIES[name](spark, sf).count() > 0
