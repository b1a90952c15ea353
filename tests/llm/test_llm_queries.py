import pytest

from loomspan.llm import catalogue
from test_queries import check, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    check(spark, name, catalogue.queries()[name], catalogue.oracles().get(name))
