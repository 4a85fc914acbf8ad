"""Every registered query of the engine: against its SQL where there is one, else that it runs."""

from __future__ import annotations

import pytest
from compare import SF, connect, same

from rerunlab import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert len(df.collect()) > 0
