"""What-if overlay: hand-computed values and explicit calendar bounds."""

import math

import pytest
from pyspark.sql import functions as F

from replenish.config import DEFAULT
from replenish.functions.scenario import Scenario
from replenish.operators.calendar import calendar_spine, densify
from replenish.operators.scenario import apply_scenario


def _rows(spark):
    return spark.createDataFrame(
        [
            (1, "H", "2000-01-03", 10.0, 2.0),   # t = 0
            (1, "H", "2001-03-05", 10.0, 2.0),   # t = 61, one week after the shock
            (2, "X", "2001-03-05", 10.0, 2.0),   # category without a profile
        ],
        "product_id long, category string, date string, demand double, lead_time double",
    ).withColumn("date", F.col("date").cast("timestamp_ntz"))


def test_hand_values(spark):
    sc = Scenario(profiles={"H": "Health"}, trend=0.0)
    got = {(r.product_id, r.date.year): r for r in apply_scenario(_rows(spark), sc, "2000-01-03", "2001-03-05").collect()}
    r0, r61, rx = got[(1, 2000)], got[(1, 2001)], got[(2, 2001)]
    assert math.isclose(r0.seasonal_effect, 0.3)                       # 0.3*cos(0)
    assert r0.shock_effect == 0.0 and r0.lead_time_disruption == 0.0   # before week 60
    assert math.isclose(r61.seasonal_effect, 0.3 * math.cos(2 * math.pi * 61 / 52))
    assert math.isclose(r61.shock_effect, 0.7 * (1 - math.exp(-0.1)))
    assert math.isclose(r61.lead_time_disruption, 0.5 * (1 - math.exp(-0.05)))
    assert math.isclose(r61.scenario_demand, 10 * (1 + r61.seasonal_effect + r61.shock_effect))
    assert math.isclose(r61.scenario_lead_time, 2 * (1 + r61.lead_time_disruption))
    assert rx.seasonal_effect == 0.0 and rx.shock_effect == 0.0 and rx.scenario_demand == 10.0


def test_slope_per_product(spark):
    df = _rows(spark)
    slopes = spark.createDataFrame([(1, 0.15)], "product_id long, slope double")
    got = {(r.product_id, r.date.year): r.trend_effect for r in apply_scenario(df, slopes=slopes, origin="2000-01-03", last="2001-03-05").collect()}
    assert math.isclose(got[(1, 2001)], 0.15 * 61 / 62)
    assert math.isclose(got[(2, 2001)], 0.05 * 61 / 62)  # no slope of its own


def test_calendar_holds_every_item_and_week(spark):
    items = spark.createDataFrame([(1, "H", 1.0, 2.0), (2, "X", 1.0, 2.0), (3, "X", 1.0, 2.0)], "product_id long, category string, unit_cost double, stockout_cost_multiplier double")
    cfg = DEFAULT.with_(calendar_start="2000-01-03", calendar_end="2001-03-05")
    assert calendar_spine(items, cfg).count() == 3 * 62
    dense = densify(_rows(spark), items, cfg)
    assert dense.count() == 3 * 62 and dense.agg(F.sum("demand")).first()[0] == 30.0
    assert dense.filter("observed").count() == 3
    late = densify(_rows(spark), items, cfg, from_first_sale=True)
    assert {r.product_id: r["count"] for r in late.groupBy("product_id").count().collect()} == {1: 62, 2: 1}


def test_calendar_is_dealt_by_the_rows_it_makes(spark, monkeypatch):
    from replenish.operators import calendar

    monkeypatch.setattr(calendar, "TASK_ROWS", 200)
    items = spark.createDataFrame([(i % 40 or None, "H") for i in range(80)], "product_id long, category string").coalesce(1)
    spine = calendar_spine(items, DEFAULT.with_(calendar_start="2000-01-03", calendar_end="2001-03-05"))
    per = [r["count"] for r in spine.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 80 * 62 and len(per) >= 20 and max(per) <= 6 * 62
    assert spine.where("product_id is null").count() == 2 * 62 == spine.where("product_id = 7").count()


def test_demand_outside_the_calendar_is_an_error(spark):
    items = spark.createDataFrame([(1, "H", 1.0, 2.0)], "product_id long, category string, unit_cost double, stockout_cost_multiplier double")
    for start, end in (("2000-01-10", "2001-03-05"), ("2000-01-03", "2001-02-26"), ("2000-01-04", "2001-03-06")):
        cfg = DEFAULT.with_(calendar_start=start, calendar_end=end)
        with pytest.raises(Exception, match="outside the calendar"):
            densify(_rows(spark), items, cfg).collect()


def test_scenario_tables_equal_the_columns(spark, inputs_small):
    from replenish.functions.scenario import Scenario, scenario_tables
    from replenish.operators.scenario import apply_scenario, apply_scenarios

    demand, _ = inputs_small
    demand = demand.withColumn("category", F.when(F.col("product_id") % 7 > 0, F.col("category")))
    several = {"a": Scenario(), "b": Scenario(shock_start=90, trend=-0.2), "c": Scenario(profiles={"SMALL": "Food"})}
    got = apply_scenarios(demand, *scenario_tables(spark, several)).cache()
    assert got.count() == 3 * demand.count()
    for name, scenario in several.items():
        want = apply_scenario(demand, scenario)
        mine = got.where(F.col("scenario") == name).select(want.columns)
        assert mine.exceptAll(want).isEmpty() and want.exceptAll(mine).isEmpty(), name
    heads, terms = scenario_tables(spark, several)
    for bad, what in ((heads.union(heads), "twice"), (heads.limit(0), "no scenario")):
        with pytest.raises(ValueError, match=what):
            apply_scenarios(demand, bad, terms)
