"""Every registered model against its SQL oracle."""

import inspect
import re

import pytest

import __spark_entry__
import tallyloom.plans  # noqa: F401
from tallyloom.plans.registry import MODELS, tagged
from tests.oracle import check, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", MODELS)
def test_model_equals_oracle(spark, con, name):
    assert check(spark, con, SMALL, MODELS[name]) is None


def test_entry_and_contract(spark):
    result = __spark_entry__.entry(spark)
    assert result.columns[0] == "customer_id"
    assert result.count() > 0
    assert set(MODELS) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# Number of operators per family in the blueprint.
FAMILIES = {
    "src": 4, "snk": 8, "prj": 10, "flt": 10, "jon": 20, "agg": 18, "win": 21, "srt": 3,
    "set": 10, "str": 10, "dat": 13, "mth": 3, "cnd": 5, "nul": 6, "par": 7, "inc": 8,
    "qlt": 10, "txt": 8, "rec": 2, "evl": 6, "cmp": 30,
}


@pytest.mark.parametrize("family", FAMILIES)
def test_every_operator_has_a_model(family):
    numbers = {re.match(rf"{family}_(\d+)_", n).group(1) for n in MODELS if n.startswith(family + "_")}
    assert numbers == {f"{i:02d}" for i in range(1, FAMILIES[family] + 1)}


def test_tags():
    assert "snk_08_tags" in [m.name for m in tagged("products")]
    assert len(tagged("win")) >= 21


HEAVY = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython")


def test_no_quadratic_join_and_no_python_in_any_plan(spark):
    skip = ("inc_", "snk_", "src_")  # these write; their inputs are other models' plans
    for name, model in MODELS.items():
        if name.startswith(skip):
            continue
        plan = model(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not [h for h in HEAVY if h in plan], name


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(MODELS["flt_04_date_range"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    plan = plan_of(MODELS["par_01_threshold"](spark, SMALL))
    assert "GreaterThanOrEqual(o_totalprice,50000.0)" in plan
    plan = plan_of(MODELS["flt_01_equality"](spark, SMALL))
    assert "EqualTo(o_orderstatus,F)" in plan


def test_bucketed_tables_join_without_an_exchange(spark):
    plan = plan_of(MODELS["snk_04_bucketed_tables"](spark, SMALL))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_exists_keys_are_distinct_before_the_exchange(spark):
    plan = plan_of(MODELS["jon_13_anti"](spark, SMALL))
    assert "LeftAnti" in plan and plan.count("HashAggregate(keys=[o_orderkey") == 2


def test_top_n_is_cut_before_the_exchange(spark):
    for name in ("win_15_latest_row", "flt_09_qualify", "win_14_top_n"):
        plan = plan_of(MODELS[name](spark, SMALL))
        assert re.search(r"WindowGroupLimit.*Partial", plan), name


def test_parameters_change_the_result(spark):
    from tallyloom.sources.readers import Tables

    t = Tables(spark, SMALL)
    for name, change in {
        "par_01_threshold": {"min_amount": 400_000}, "par_02_value": {"segment": "BUILDING"},
        "par_03_date_window": {"end_date": "1999-12-31"}, "par_04_switch": {"include_inactive": True},
        "par_05_target": {"target": "dev"}, "srt_03_limit_parameter": {"limit_rows": 3},
    }.items():
        build = MODELS[name].build
        assert set(change) <= set(inspect.signature(build).parameters)
        assert build(t, **change).count() != build(t).count(), name
    assert MODELS["snk_07_chosen_kind"].build(t, mat_type="table").count() == t.orders.count()
    with pytest.raises(ValueError, match="kind must be"):
        MODELS["snk_07_chosen_kind"].build(t, mat_type="cube")
    with pytest.raises(ValueError, match="no column"):
        MODELS["agg_18_named_key"].build(t, group_by_col="colour")
    with pytest.raises(KeyError, match="unknown source"):
        t.source("refunds")
