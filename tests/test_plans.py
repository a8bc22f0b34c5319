"""Physical-plan checks: push-down, no Python in the data path, top-k."""

import io
from contextlib import redirect_stdout

import pytest

from replenish.operators import compare, panel
from replenish.plans.queries import QUERIES
from replenish.sources.tables import load_inputs

from paths import SF0001


def _plan(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize(
    ("name", "bounds"),
    [
        ("training_set", ["LessThan(l_shipdate"]),
        ("policy_params", ["LessThan(l_shipdate"]),
        ("testing_set", ["GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate"]),
        ("test_features_actuals", ["GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate"]),
    ],
)
def test_date_bounds_reach_the_scan(spark, name, bounds):
    text = _plan(QUERIES[name](spark, SF0001))
    pushed = [line for line in text.splitlines() if "PushedFilters" in line and "l_orderkey" in line]
    assert pushed and all(all(b in line for b in bounds) for line in pushed)


def test_profile_has_no_expand(spark):
    assert "Expand" not in _plan(QUERIES["demand_profile"](spark, SF0001))


def test_panel_and_scenario_read_the_line_items_once(spark):
    for name in ("densified_demand", "scenario_demand", "scenario_lead_time"):
        text = _plan(QUERIES[name](spark, SF0001), "simple")
        assert text.count("l_shipdate") and text.count("lineitem.parquet") == 1, name
    assert "lineitem" not in _plan(QUERIES["calendar_spine"](spark, SF0001), "simple")


def test_exploded_levels_are_never_broadcast(spark):
    """The planner takes a dozen rows an item for one; the driver would hold them all."""
    lines = _plan(QUERIES["service_level_policies"](spark, SF0001), "simple").splitlines()
    assert any("Generate explode" in x for x in lines)
    assert not any("BroadcastExchange" in a and "Generate" in b for a, b in zip(lines, lines[1:]))


def test_scans_read_only_needed_columns(spark):
    demand, items = load_inputs(spark, SF0001)
    text = _plan(compare.plan_comparison(panel.policy_panel(demand, items)))
    for line in text.splitlines():
        if "ReadSchema" in line and "l_orderkey" in line:
            assert "l_extendedprice" not in line and "l_comment" not in line


def test_no_python_udf_in_the_panel(spark):
    demand, items = load_inputs(spark, SF0001)
    df = compare.plan_comparison(panel.policy_panel(demand, items))
    df.collect()  # the adaptive plan shows its codegen stages once final
    text = _plan(df)
    assert "isFinalPlan=true" in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "* HashAggregate" in text and "* Project" in text  # codegen stages


def test_product_top_k_is_take_ordered(spark):
    demand, items = load_inputs(spark, SF0001)
    text = _plan(compare.product_comparison(panel.policy_panel(demand, items)))
    assert "TakeOrderedAndProject" in text


def test_no_cartesian_product_anywhere(spark):
    for name, q in QUERIES.items():
        if name.startswith("gbt") or name.endswith("_gbt") or name == "forecast_coverage":
            continue
        text = _plan(q(spark, SF0001), "simple")
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
