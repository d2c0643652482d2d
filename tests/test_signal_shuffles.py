import pytest

from plethora.plans import QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", ["ecg_template", "feature_rows"])
def test_only_the_intervals_are_shuffled(spark, name):
    """A recording's samples, over a hundred times its intervals, stay in the group that makes them."""
    plan = QUERIES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
