"""Every query against its SQL on the smallest data folder."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLANS, SQLS = contract.queries(), contract.oracle_sql()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, con, name):
    df = PLANS[name](spark, SF_DIR)
    assert compare(df, con, SQLS.get(name)) == ""
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry(spark):
    row = contract.entry(spark).head()
    assert row["n_records"] > 0


def test_oracle_names_are_queries():
    assert set(SQLS) <= set(PLANS)
