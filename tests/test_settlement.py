"""Hand-made settlement rows (FIXTURES §5) and invariants on real data."""

import math

import pytest
from pyspark.sql import functions as F

from replenish.functions.settlement import SETTLEMENT_COLUMNS, settlement_columns

SCHEMA = "case string, start double, demand double, qty double, unit_cost double, mult double"

# case, start, demand, order_qty, unit_cost, mult ->
# fulfilled, stockout, ending, holding, stockout_cost, order_cost, service
ROWS = [
    ("surplus", 100.0, 48.0, 10.0, 52.0, 2.0, (48, 0, 52, 13, 0, 50, 1)),
    ("short", 30.0, 40.0, 0.0, 10.0, 3.0, (30, 10, 0, 0, 300, 0, 0.75)),
    ("exact", 40.0, 40.0, 1.0, 10.0, 3.0, (40, 0, 0, 0, 0, 50, 1)),
    ("no demand", 10.0, 0.0, 0.0, 52.0, 2.0, (0, 0, 10, 2.5, 0, 0, 1)),
]


def _settle(spark, rows):
    df = spark.createDataFrame([r[:6] for r in rows], SCHEMA)
    cols = settlement_columns(start="start", demand="demand", order_qty="qty", unit_cost="unit_cost",
                              multiplier="mult")
    return {r["case"]: r for r in df.select("case", *[cols[c].alias(c) for c in SETTLEMENT_COLUMNS]).collect()}


def test_hand_rows(spark):
    got = _settle(spark, ROWS)
    for case, *_, expect in ROWS:
        r = got[case]
        actual = (r.fulfilled_demand, r.stockout, r.ending_inventory, r.holding_cost, r.stockout_cost,
                  r.order_cost, r.service_level)
        for a, e in zip(actual, expect):
            assert math.isclose(a, e, abs_tol=1e-9), (case, actual, expect)
        assert math.isclose(r.total_cost, r.holding_cost + r.stockout_cost + r.order_cost)


def test_unknown_policy_is_null_but_order_cost_counts(spark):
    got = _settle(spark, [("unknown", None, 5.0, 1.0, 10.0, 2.0)])["unknown"]
    for c in ("fulfilled_demand", "stockout", "ending_inventory", "holding_cost", "stockout_cost",
              "total_cost", "service_level"):
        assert got[c] is None, c
    assert got.order_cost == 50.0


@pytest.fixture(scope="module")
def settled(inputs_small):
    from replenish.operators.panel import policy_panel

    demand, items = inputs_small
    return policy_panel(demand, items).cache()


def test_invariants(settled):
    bad = settled.filter(
        (F.abs(F.col("fulfilled_demand") + F.col("stockout") - F.col("actual_demand")) > 1e-9)
        | (F.col("ending_inventory") * F.col("stockout") != 0)
        | (F.col("service_level") < 0)
        | (F.col("service_level") > 1)
        | (F.abs(F.col("total_cost") - F.col("holding_cost") - F.col("stockout_cost") - F.col("order_cost")) > 1e-6)
    )
    assert bad.count() == 0


def test_adaptive_policy_never_stocks_out_more(settled):
    pivot = settled.groupBy("product_id", "date").pivot("policy", ["Traditional", "Context Aware"]).agg(
        F.first("stockout")
    )
    assert pivot.filter(F.col("Context Aware") > F.col("Traditional") + 1e-9).count() == 0
