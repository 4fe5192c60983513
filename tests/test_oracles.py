"""Every query with SQL, against it, on the smallest tables; plus plan checks."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# Grown forests are covered by test_forest; these are slow for their overhead alone.
SLOW = {"prep_prepared_width", "chart_corr_matrix_wide", "rf_split_linear", "rf_split_cls"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["prof_missing", "out_iqr", "met_mse", "met_prf_weighted", "cmp_rep_stats", "rf_bootstrap", "surf_local"])
def test_plans_stay_out_of_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan


def test_scans_read_only_what_is_used(spark):
    plan = _plan(entry.queries()["prof_duplicates"](spark, SF))
    assert "l_extendedprice" not in plan and "l_quantity" in plan


def test_split_is_a_pushed_filter_without_a_join(spark):
    plan = _plan(entry.queries()["prep_split"](spark, SF))
    assert "Join" not in plan and "Exchange" not in plan
