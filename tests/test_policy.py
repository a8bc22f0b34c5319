"""Policy maths and edge cases (FIXTURES §5)."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from replenish.config import PlanConfig, Z_95
from replenish.functions import policy_math as pm
from replenish.operators import features, policy


def test_eoq_value_and_zero_cost(spark):
    df = spark.createDataFrame([(10.0, 16.0), (10.0, 0.0)], "d double, c double")
    got = [r.e for r in df.select(pm.eoq("d", "c", 0.25).alias("e")).collect()]
    assert math.isclose(got[0], math.sqrt(2 * 520 * 50 / 4), rel_tol=1e-15)
    assert math.isclose(got[0], 114.0175425099138, rel_tol=1e-12)
    assert got[1] is None


def test_z_literal_and_inverse_normal(spark):
    assert F.lit(Z_95) is not None
    ps = [0.001, 0.02, 0.3, 0.5, 0.8, 0.95, 0.975, 0.999, 1e-12]
    df = spark.createDataFrame([(p,) for p in ps] + [(0.0,), (1.0,)], "p double")
    got = [r.z for r in df.select(pm.z_score(F.col("p")).alias("z")).collect()]
    for p, z in zip(ps, got):
        assert math.isclose(z, NormalDist().inv_cdf(p), rel_tol=1e-12, abs_tol=1e-12), p
    assert got[-2] is None and got[-1] is None


def test_single_row_product_has_no_policy(spark):
    train = spark.createDataFrame(
        [(1, "A", "2000-01-03", 5.0, 2.0), (2, "A", "2000-01-03", 4.0, 1.0), (2, "A", "2000-01-10", 6.0, 3.0)],
        "product_id long, category string, date string, demand double, lead_time double",
    ).withColumn("date", F.col("date").cast("timestamp_ntz"))
    items = spark.createDataFrame([(1, "A", 10.0, 2.0), (2, "A", 10.0, 2.0)],
                                  "product_id long, category string, unit_cost double, stockout_cost_multiplier double")
    p = {r.product_id: r for r in policy.product_params(train, items).collect()}
    assert p[1].demand_std is None and p[1].safety_stock is None and p[1].reorder_point is None
    assert p[2].safety_stock is not None


def test_missing_buffer_orders_nothing(spark):
    cfg = PlanConfig(buffers={"A": 0.1})
    rows = spark.createDataFrame(
        [(1, "A", 10.0, 2.0, 5.0, 1.5), (2, "B", 10.0, 2.0, 5.0, 1.5)],
        "product_id long, category string, forecast_demand double, lead_time double, safety_stock double, "
        "lead_time_avg double",
    )
    got = {r.product_id: r for r in rows.withColumns(policy.context_columns(cfg)).collect()}
    assert got[1].order_quantity > 0
    assert got[2].required_inventory is None and got[2].order_quantity == 0.0


def test_three_training_rows_give_no_matrix_rows(spark):
    train = spark.createDataFrame(
        [(1, "A", f"2000-01-{d:02d}", 5.0, 2.0) for d in (3, 10, 17)],
        "product_id long, category string, date string, demand double, lead_time double",
    ).withColumn("date", F.col("date").cast("timestamp_ntz"))
    assert features.training_matrix(train).count() == 0


def test_lag_equals_self_join_by_row_number(spark, inputs_small):
    from pyspark.sql import Window

    demand, _ = inputs_small
    w = Window.partitionBy("product_id").orderBy("date")
    numbered = demand.withColumn("rn", F.row_number().over(w))
    prev = numbered.select("product_id", (F.col("rn") + 1).alias("rn"), F.col("demand").alias("prev"))
    joined = features.with_history(numbered).join(prev, ["product_id", "rn"], "left")
    assert joined.filter(~F.col("lag_demand").eqNullSafe(F.col("prev"))).count() == 0


def test_split_is_disjoint_and_half_open(spark, inputs_small):
    from replenish.operators.split import split_train_test

    demand, _ = inputs_small
    train, test = split_train_test(demand)
    assert train.join(test, ["product_id", "date"]).count() == 0
    assert test.filter(F.col("date") == F.lit("2001-01-01").cast("timestamp_ntz")).count() > 0


def test_reference_api_path_equals_one_pass_panel(spark, inputs_small):
    """product_params -> baseline/context plan -> settle gives the panel's numbers."""
    from replenish.config import DEFAULT
    from replenish.operators import panel, settle, split

    demand, items = inputs_small
    train, test = split.split_train_test(demand)
    params = policy.product_params(train, items)
    base = settle.settle(policy.baseline_plan(test, params), items)
    preds = features.test_features_carry(demand, DEFAULT, signals=None).withColumn(
        "forecast_demand", F.col("demand_ma_4"))
    ctx = settle.settle(policy.context_plan(preds, params, fallback_to_mean=True), items)
    api = panel.tag_policies(base, ctx)
    one = panel.policy_panel(demand, items).select(*api.columns)
    keys = ["policy", "product_id", "date"]
    j = api.alias("a").join(one.alias("b"), keys, "full")
    assert j.count() == api.count() == one.count()
    for c in ("total_cost", "service_level", "ending_inventory", "order_cost"):
        assert j.filter(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > 1e-6).count() == 0, c


def test_buffers_from_a_table(spark, inputs_small):
    from replenish.operators import policy

    demand, _ = inputs_small
    table = spark.createDataFrame([("ECONOMY", 0.3), ("PROMO", None), (None, 0.9), ("unused", 0.1)], "category string, buffer double")
    rows = demand.withColumn("category", F.when(F.col("product_id") % 5 > 0, F.col("category")))
    got = {r.category: r.buffer for r in policy.with_buffers(rows, table, 0.07).select("category", "buffer").distinct().collect()}
    assert got["ECONOMY"] == 0.3 and got["PROMO"] == got[None] == got["SMALL"] == 0.07
    report = {r.category: r for r in policy.buffer_coverage(rows, table).collect()}
    assert sum(r.n_rows for r in report.values()) == rows.count()
    assert report["ECONOMY"].matched and not report["PROMO"].matched and report["SMALL"].buffer is None
    with pytest.raises(ValueError, match="several buffers for category ECONOMY"):
        policy.with_buffers(rows, table.union(table), 0.07)


def test_levels_outside_give_no_stock(spark, inputs_small):
    from replenish.operators import policy

    demand, items = inputs_small
    levels = items.select("product_id", F.explode(F.array(*(F.lit(x).cast("double") for x in (0.95, 0.0, 1.0, -3.0, None, float("nan"))))).alias("service_level"))
    rows = policy.service_level_policies(demand, levels)
    assert rows.where("z is not null").select("service_level").distinct().collect() == [(0.95,)]
    both = rows.where("service_level = 0.95").join(policy.product_params(demand, items), "product_id")
    gap = F.abs(rows.safety_stock - F.col("s"))
    named = policy.product_params(demand, items).select("product_id", F.col("safety_stock").alias("s"))
    assert rows.where("service_level = 0.95").join(named, "product_id").where(gap > 1e-9).count() == 0 and both.count() > 0
