"""Bring-your-own canonical tables (X6) and contract validation (FL7)."""

import tempfile

import pytest
from pyspark.sql import functions as F

from replenish.operators import compare, panel
from replenish.sources.tables import canonical_demand, check_contract, contract_report, contract_violations, load_inputs, read_canonical, weekly_demand

from paths import SF0001


def test_read_canonical_gives_same_comparison(spark):
    demand, items = load_inputs(spark, SF0001)
    root = tempfile.mkdtemp(prefix="replenish-byo-")
    # A user's table may carry other types and extra columns; the reader casts and selects.
    demand.withColumn("product_id", F.col("product_id").cast("int")).withColumn("note", F.lit("x")) \
        .write.parquet(f"{root}/demand")
    items.write.parquet(f"{root}/items")
    d2, i2 = read_canonical(spark, f"{root}/demand", f"{root}/items")
    assert d2.columns == ["product_id", "category", "date", "demand", "lead_time"]
    want = {r.Metric: r for r in compare.plan_comparison(panel.policy_panel(demand, items)).collect()}
    got = {r.Metric: r for r in compare.plan_comparison(panel.policy_panel(d2, i2)).collect()}
    for m, r in want.items():
        assert got[m].Traditional == pytest.approx(r.Traditional, rel=1e-12)
        assert got[m].Context_Aware == pytest.approx(r.Context_Aware, rel=1e-12)


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, "A")], "product_id long, category string")
    with pytest.raises(ValueError, match=r"\['date', 'demand', 'lead_time'\]"):
        canonical_demand(df)


def test_contract_breaks_are_named(spark):
    demand = spark.createDataFrame([(1, "A", "2000-01-03"), (2, "B", "2000-01-03"), (2, "B", "2000-01-10")], "product_id long, category string, date string")
    items = spark.createDataFrame([(1, "A"), (2, "B")], "product_id long, category string")
    check_contract(demand, items)
    with pytest.raises(ValueError, match="several rows for a product and week.*product_id 1"):
        check_contract(demand.union(demand.filter("product_id = 1")), items)
    with pytest.raises(ValueError, match="several categories.*product_id 2"):
        check_contract(demand.union(spark.createDataFrame([(2, "C", "2000-01-17")], demand.schema)), items)
    with pytest.raises(ValueError, match="items has several rows.*product_id 2"):
        check_contract(demand, items.union(items.filter("product_id = 2")))


def test_missing_input_column_raises(spark):
    root = tempfile.mkdtemp(prefix="replenish-gap-")
    for t in ("orders", "part"):
        spark.read.parquet(f"{SF0001}/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    spark.read.parquet(f"{SF0001}/lineitem.parquet").drop("l_quantity").write.parquet(f"{root}/lineitem.parquet")
    with pytest.raises(ValueError, match="l_quantity"):
        weekly_demand(spark, root)


def test_a_product_has_one_row_and_the_items_category(spark, inputs_small):
    demand, items = inputs_small
    turned = demand.withColumn("category", F.when(F.month("date") > 3, F.lit("LARGE")).otherwise(F.col("category")))
    rows = compare.product_comparison(panel.policy_panel(turned, items), items=items).collect()
    assert len({r.product_id for r in rows}) == len(rows) == 10
    named = {r.product_id: r.category for r in items.collect()}
    assert all(r.category == named[r.product_id] for r in rows)


def test_every_rule_is_counted(spark):
    demand = spark.createDataFrame(
        [
            (1, "A", "2000-01-03", 5.0),
            (1, "A", "2000-01-03", 6.0),
            (1, "A", "2000-01-03", 6.0),
            (2, "B", "2000-01-10", -1.0),
            (2, "C", "2000-01-17", -2.0),
            (3, "A", "2000-01-04", 1.0),
            (3, "A", "1980-01-07", 1.0),
            (None, "A", "2000-01-03", 1.0),
            (4, "A", None, 1.0),
        ],
        "product_id long, category string, date string, demand double",
    )
    items = spark.createDataFrame([(1, "A"), (2, "B"), (2, "B"), (2, "B"), (4, "A"), (9, "Z")], "product_id long, category string")
    got = {r.rule: tuple(r)[1:] for r in contract_report(demand, items).collect()}
    assert got == {
        "null_key": (2, 2, 4),
        "duplicate_week": (1, 2, 1),
        "several_categories": (1, 1, 2),
        "off_calendar": (1, 2, 3),
        "negative_demand": (1, 2, 2),
        "item_missing": (1, 2, 3),
        "duplicate_item": (1, 2, 2),
    }
    clean = {r.rule: tuple(r)[1:] for r in contract_report(demand.limit(0), items.limit(0)).collect()}
    assert set(clean.values()) == {(0, 0, None)} and len(clean) == 7
    plan = contract_violations(demand, items)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan
