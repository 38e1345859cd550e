"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.compare import difference, views
from verisift.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(plans.QUERIES[name](spark, SF), con, plans.ORACLES[name]) is None


def test_flagship_has_no_python_and_no_nested_loop(spark):
    plan = plans.flagship_reward_by_paper(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan
