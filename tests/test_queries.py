"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

from compare import compare, connect
from tributary.plans.queries import ORACLES, QUERIES, forget_staged

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

NO_TWIN: set[str] = set()


@pytest.fixture(scope="module")
def con(spark):
    forget_staged()
    return connect(FOLDER)


def test_twins_are_complete():
    assert set(QUERIES) - set(ORACLES) == NO_TWIN


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, FOLDER, name)
    assert result["ok"] is not False, result["detail"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_has_no_pairing_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
