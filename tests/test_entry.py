import pytest

import __spark_entry__ as entry
from tests.compare import check, tables
from weirmill.plans import core, skewed


@pytest.fixture(scope="module")
def con():
    return tables()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted({**core.ORACLES, **skewed.ORACLES}))
def test_query_equals_sql(spark, con, name):
    check(spark, con, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
