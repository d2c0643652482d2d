import pytest

from plethora.llm import queries
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])
