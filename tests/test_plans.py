"""Plan-shape regression tests: the physical properties the scale design relies on."""

import re

import pytest

import __spark_entry__ as entry
from tallyspark.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.01"


def _plan(spark, key):
    df = entry.queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: _plan(spark, k) for k in QUERIES}


def test_no_cartesian_products(plans):
    assert [k for k, p in plans.items() if "CartesianProduct" in p] == []


def test_no_nested_loop_joins(plans):
    assert [k for k, p in plans.items() if "BroadcastNestedLoopJoin" in p] == []


def test_period_filters_reach_the_scan(plans):
    p = plans["q01_city_label"]
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate,1997-10-01", p)
    r = plans["q14_retention"]
    assert "GreaterThanOrEqual(o_orderdate,1997-06-01" in r and "GreaterThanOrEqual(o_orderdate,1997-07-01" in r


@pytest.mark.parametrize("key", ["q19_positional_crosstab", "q24_transpose",
                                 "q24b_top5_pivot"])
def test_top_n_windows_are_limited_before_the_shuffle(plans, key):
    assert "WindowGroupLimit" in plans[key]


@pytest.mark.parametrize("key", ["q10_latest_row", "q11_role_flags", "q03c_contract_features", "q05_penetration"])
def test_hot_key_reductions_use_partial_aggregation_not_windows(plans, key):
    p = plans[key]
    assert "Window " not in p and "Window(" not in p
    assert "HashAggregate" in p or "ObjectHashAggregate" in p or "SortAggregate" in p


def test_no_python_udfs(plans):
    assert [k for k, p in plans.items() if re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF", p)] == []
