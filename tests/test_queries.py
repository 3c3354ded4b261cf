"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from gleanwork.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert problem is None


def test_plans_stay_in_the_engine(spark):
    """Search, upsert and mapping plans run no Python, prune columns and push filters."""
    for name in ("search_page", "facet_siblings", "bronze_upsert", "tombstone", "posting_filters", "json_index_explode"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan, name
    plan = QUERIES["facet_company"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and plan.count("Scan parquet") <= 2
    pushed = QUERIES["search_after"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_orderdate" in pushed
    mapped = QUERIES["json_detail_map"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in mapped and "SortMergeJoin" not in mapped
