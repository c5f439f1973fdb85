import pytest

from sedge.llm.queries import ORACLE, QUERIES
from tests.support import check_query


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    check_query(spark, QUERIES[name], ORACLE.get(name))


@pytest.mark.parametrize("number", range(1, 14))
def test_every_operator_is_registered_once(number):
    assert len([n for n in QUERIES if n.startswith(f"op{number}_")]) == 1
