"""Every registered query against its SQL, or for rows, over the smallest tables."""

import pytest
from compare import compare, connect

from rankweave.plans import registry

ONLY_ROWS = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    assert compare(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], con) == []


@pytest.mark.parametrize("name", ONLY_ROWS)
def test_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
