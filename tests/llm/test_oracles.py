import pytest

from tests.compare import check, tables
from weirmill.llm.oracles import ORACLES


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    check(spark, con, name)
