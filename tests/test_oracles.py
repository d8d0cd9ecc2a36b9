"""Every query against its SQL on the given tables."""

import os

import pytest

import compare
from leadgrid.catalog.oracles import ORACLES
from leadgrid.catalog.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# no SQL: models
ROWS_ONLY = {"walk_forward_gbt", "ablation_gbt", "seed_sweep_gbt", "seed_noise", "batch_forecast"}
# neither products of tables nor Python workers belong in a data query
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_an_oracle_or_is_a_model():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    got = result.toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert compare.schema_of(got) == compare.schema_of(want)
    assert compare.rows_of(got) == compare.rows_of(want)
