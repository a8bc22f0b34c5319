"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each query reads the whole input tables at ``sf_dir`` and composes the
library's operators. Only the final projection rounds (doubles to 6 places,
money totals to 2) so results compare exactly with the SQL oracle in
``oracle.py``, which rounds the same columns the same way.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import DEFAULT, DEFAULT_BUFFERS, PlanConfig
from ..operators import compare, features, panel, policy, settle, split
from ..functions.calendar import add_signals
from ..functions.scenario import Scenario, scenario_tables
from ..sources.tables import contract_report, items_from_parts, load_inputs, weekly_demand
from . import views

Query = Callable[[SparkSession, str], DataFrame]


def finish(df: DataFrame, money=(), digits: int = 6) -> DataFrame:
    """Round double columns: ``money`` columns to 2 places, the rest to ``digits``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType):
            # "+ 0.0" turns a rounded -0.0 into 0.0 so both engines print the same zero.
            cols.append((F.round(F.col(f.name), 2 if f.name in money else digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- inputs


def q_weekly_demand(spark, sf_dir):
    return weekly_demand(spark, sf_dir)


def q_item_info(spark, sf_dir):
    return items_from_parts(spark, sf_dir)


def q_demand_profile(spark, sf_dir):
    return split.demand_profile(weekly_demand(spark, sf_dir))


def q_split_profile(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return split.split_profile(weekly_demand(spark, sf_dir, cfg.test_cutoff), cfg)


def q_training_set(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return split.split_train_test(weekly_demand(spark, sf_dir, cfg.train_cutoff), cfg)[0]


def q_testing_set(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return split.split_train_test(weekly_demand(spark, sf_dir, cfg.test_cutoff, since=cfg.train_cutoff), cfg)[1]


# ---------------------------------------------------------------- policy


def q_policy_params(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    demand, items = load_inputs(spark, sf_dir, cfg.train_cutoff)
    train = split.split_train_test(demand, cfg)[0]
    return finish(policy.product_params(train, items, cfg))


def _planning_rows(spark, sf_dir, cfg):
    demand, items = load_inputs(spark, sf_dir, cfg.test_cutoff, costs_on_demand=True)
    return panel.planning_rows(demand, items, cfg)


def q_baseline_plan(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(panel.baseline_from_rows(_planning_rows(spark, sf_dir, cfg)))


def q_context_plan(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    """Context-aware plan with the deterministic forecaster (trailing four-week
    mean over the history, falling back to the training mean)."""
    return finish(panel.context_from_rows(_planning_rows(spark, sf_dir, cfg)))


def q_settle_baseline(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    plan = panel.baseline_from_rows(_planning_rows(spark, sf_dir, cfg), keep_costs=True)
    return finish(settle.settle(plan, cfg=cfg))


def q_settle_context(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    plan = panel.context_from_rows(_planning_rows(spark, sf_dir, cfg), keep_costs=True)
    return finish(settle.settle(plan, cfg=cfg))


# ---------------------------------------------------------------- features


FEATURE_ORDER = (
    "date", "product_id", "category", "demand", "lead_time",
    "weekofyear", "month", "dayofweek",
    "lag_demand", "lag_demand_2", "lag_demand_3", "demand_ma_4",
    "promo_flag", "holiday_flag",
)


def q_calendar_features(spark, sf_dir):
    d = features.with_calendar(weekly_demand(spark, sf_dir))
    return d.select("product_id", "date", "weekofyear", "month", "dayofweek")


def q_signals(spark, sf_dir):
    d = add_signals(features.with_calendar(weekly_demand(spark, sf_dir)))
    return d.select("product_id", "date", "month", "promo_flag", "holiday_flag")


def q_lag_features(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    train = split.split_train_test(weekly_demand(spark, sf_dir, cfg.train_cutoff), cfg)[0]
    return features.with_history(train).select("product_id", "date", "demand", *features.LAG_COLUMNS)


def q_moving_average(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    train = split.split_train_test(weekly_demand(spark, sf_dir, cfg.train_cutoff), cfg)[0]
    return finish(features.with_history(train).select("product_id", "date", "demand", features.MA_COLUMN))


def q_training_matrix(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    train = split.split_train_test(weekly_demand(spark, sf_dir, cfg.train_cutoff), cfg)[0]
    return finish(features.training_matrix(train).select(*FEATURE_ORDER))


def q_test_features_actuals(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    test = split.split_train_test(weekly_demand(spark, sf_dir, cfg.test_cutoff, since=cfg.train_cutoff), cfg)[1]
    return finish(features.test_features_actuals(test).select(*FEATURE_ORDER))


def q_test_features_carry(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(features.test_features_carry(weekly_demand(spark, sf_dir, cfg.test_cutoff), cfg).select(*FEATURE_ORDER))


# ---------------------------------------------------------------- comparisons

MONEY = (
    "total_holding_cost", "total_stockout_cost", "total_order_cost", "total_cost",
    "Traditional_Cost", "Context_Aware_Cost", "sum_context_aware_cost", "sum_traditional_cost",
)


def _panel(spark, sf_dir, cfg):
    demand, items = load_inputs(spark, sf_dir, cfg.test_cutoff, costs_on_demand=True)
    return panel.policy_panel(demand, items, cfg)


def q_kpi_baseline(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    sim = settle.settle(panel.baseline_from_rows(_planning_rows(spark, sf_dir, cfg), keep_costs=True), cfg=cfg)
    return finish(sim.agg(*compare.kpi_aggregates()), money=MONEY)


def q_kpi_overall(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(compare.performance_metrics(_panel(spark, sf_dir, cfg)), money=MONEY)


def _comparison_table(df):
    # Cost rows are money; round them to 2 places, everything else to 6.
    money = F.col("Metric").isin("Total Cost")
    return df.select(
        "Metric",
        *[
            F.when(money, F.round(c, 2)).otherwise(F.round(c, 6)).alias(c)
            for c in ("Traditional", "Context_Aware")
        ],
        F.round("Improvement_Percent", 6).alias("Improvement_Percent"),
    )


def q_plan_comparison(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return _comparison_table(compare.plan_comparison(_panel(spark, sf_dir, cfg)))


def q_category_comparison(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(compare.category_comparison(_panel(spark, sf_dir, cfg)), money=MONEY)


def q_forecast_accuracy(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(compare.forecast_accuracy(_panel(spark, sf_dir, cfg)))


def q_product_comparison(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(compare.product_comparison(_panel(spark, sf_dir, cfg), items=items_from_parts(spark, sf_dir)), money=("traditional_cost", "context_cost", "cost_saving"))


# ---------------------------------------------------------------- dashboard


def q_stockouts_inventory_over_time(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(views.stockouts_inventory_over_time(_panel(spark, sf_dir, cfg)))


def q_forecast_comparison(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(views.forecast_comparison(*load_inputs(spark, sf_dir, costs_on_demand=True), cfg))


def q_service_level_by_category(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(views.service_level_by_category(_panel(spark, sf_dir, cfg)))


def q_cost_by_category(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(views.cost_by_category(_panel(spark, sf_dir, cfg)), money=MONEY)


def q_weekly_inventory(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(views.weekly_inventory(_panel(spark, sf_dir, cfg)))


def q_weekly_stockouts(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(views.weekly_stockouts(_panel(spark, sf_dir, cfg)))


def q_weekly_demand_vs_forecast(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return finish(views.weekly_demand_vs_forecast(*load_inputs(spark, sf_dir, costs_on_demand=True), cfg), money=(
        "sum_demand", "sum_context_aware_forecast", "sum_traditional_forecast"))


# ---------------------------------------------------------------- calendar


def q_calendar_spine(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    from ..operators.calendar import calendar_spine

    return calendar_spine(items_from_parts(spark, sf_dir), cfg)


def q_densified_demand(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    from ..operators.calendar import expand_weeks, within_calendar

    return expand_weeks(within_calendar(weekly_demand(spark, sf_dir, every_part=True), cfg, unsold=True), cfg)


# ---------------------------------------------------------------- scenario overlay


def q_scenario_demand(spark, sf_dir):
    from ..operators.scenario import apply_scenario

    out = apply_scenario(weekly_demand(spark, sf_dir))
    return finish(out.select("product_id", "category", "date", "demand", "seasonal_effect", "trend_effect",
                             "shock_effect", "scenario_demand"))


def q_scenario_lead_time(spark, sf_dir):
    from ..operators.scenario import apply_scenario

    out = apply_scenario(weekly_demand(spark, sf_dir))
    return finish(out.select("product_id", "date", "lead_time", "lead_time_disruption", "scenario_lead_time"))


#: Three scenarios over one demand table: as given, a later shock, a steeper trend.
SCENARIOS = {
    "given": Scenario(),
    "late_shock": Scenario(shock_start=100),
    "steep_trend": Scenario(trend=0.15),
}


def q_scenario_comparison(spark, sf_dir):
    from ..operators.scenario import apply_scenarios

    out = apply_scenarios(weekly_demand(spark, sf_dir), *scenario_tables(spark, SCENARIOS))
    return finish(out.select("scenario", "product_id", "date", "seasonal_effect", "trend_effect", "shock_effect",
                             "scenario_demand", "scenario_lead_time"))


# ---------------------------------------------------------------- contract, dimension tables, service levels


def q_contract_report(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    """All rules over the whole inputs, with a calendar that ends at the test cutoff (so one rule is broken)."""
    report = contract_report(*load_inputs(spark, sf_dir), cfg.with_(calendar_end=cfg.test_cutoff))
    return report.select("rule", "n_products", "n_breaks")


#: A buffer table without a row for STANDARD, and what such a category gets.
BUFFERS = tuple((c, b) for c, b in DEFAULT_BUFFERS.items() if c != "STANDARD")
DEFAULT_BUFFER = 0.12


def _buffers(spark):
    return spark.createDataFrame(BUFFERS, "category string, buffer double")


def q_buffer_coverage(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    return policy.buffer_coverage(weekly_demand(spark, sf_dir), _buffers(spark), DEFAULT_BUFFER)


def q_context_plan_buffers(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    demand, items = load_inputs(spark, sf_dir, cfg.test_cutoff, costs_on_demand=True)
    rows = panel.planning_rows(demand, items, cfg, buffers=_buffers(spark), default_buffer=DEFAULT_BUFFER)
    return finish(panel.context_from_rows(rows))


#: Levels in the middle, in both tails and outside (0, 1); not 0.5, where stocks are short decimals that the two engines may round apart at a tie.
LEVELS = (0.55, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999, 0.02, 0.0001, 0.0, 1.0, None)


def q_service_level_policies(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    demand, items = load_inputs(spark, sf_dir, cfg.train_cutoff)
    levels = items.select("product_id", F.explode(F.array(*(F.lit(x).cast("double") for x in LEVELS))).alias("service_level"))
    return finish(policy.service_level_policies(split.split_train_test(demand, cfg)[0], levels))


# ---------------------------------------------------------------- incremental refresh


def _refreshed(spark, sf_dir, cfg):
    """The state after three loads and one week loaded again."""
    from ..session import scratch_folder
    from .refresh import Store, load

    store = Store(scratch_folder(spark, "planning-state"))
    cuts = (cfg.calendar_start, "1998-03-11", "2000-06-01", cfg.test_cutoff)
    for since, before in zip(cuts, cuts[1:]):
        load(spark, store, sf_dir, since, before)
    load(spark, store, sf_dir, "1999-05-03", "1999-05-10")
    return store


def q_refreshed_stats(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    from .refresh import product_stats

    return finish(product_stats(spark, _refreshed(spark, sf_dir, cfg), cfg.train_cutoff))


def q_stored_weeks(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    from .refresh import weeks

    return weeks(spark, _refreshed(spark, sf_dir, cfg), cfg.train_cutoff, cfg.test_cutoff)


# ---------------------------------------------------------------- model (rows-only check)


def q_gbt_forecast(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    from ..operators.forecast import gbt_forecasts

    return finish(gbt_forecasts(weekly_demand(spark, sf_dir, cfg.test_cutoff), cfg))


def _scored(spark, sf_dir, cfg):
    """Inputs and the history rows that the models scored; the roll-up runs once, into the model's table."""
    from ..operators.forecast import model_rows

    demand, items = load_inputs(spark, sf_dir, cfg.test_cutoff, costs_on_demand=True)
    return demand, items, model_rows(panel.history_rows(demand, items, cfg), cfg)


def q_context_plan_gbt(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    demand, items, scored = _scored(spark, sf_dir, cfg)
    return finish(panel.context_from_rows(panel.planning_rows(demand, items, cfg, scored=scored)))


def q_gbt_accuracy(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    demand, items, scored = _scored(spark, sf_dir, cfg)
    return finish(compare.forecast_accuracy(panel.policy_panel(demand, items, cfg, scored=scored)))


def _featured(spark, sf_dir, cfg):
    from ..operators.forecast import featured

    return featured(weekly_demand(spark, sf_dir, cfg.test_cutoff), cfg)


def q_model_inputs(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    """What each category's model is fitted on: rows, label sum, range of each feature."""
    from ..operators.forecast import training_rows

    rows = training_rows(_featured(spark, sf_dir, cfg), cfg)
    ranges = [g(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cfg.features for n, g in (("min", F.min), ("max", F.max))]
    return finish(rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("demand").alias("sum_demand"), *ranges))


def q_assembled_features(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    """The assembler's vector of every training row, taken apart again."""
    from pyspark.ml.functions import vector_to_array

    from ..operators.forecast import assembler, training_rows

    rows = assembler(cfg.features).transform(training_rows(_featured(spark, sf_dir, cfg), cfg))
    parts = vector_to_array("features")
    return finish(rows.select("product_id", "date", *(parts[i].alias(f"x_{c}") for i, c in enumerate(cfg.features))))


def q_forecast_coverage(spark, sf_dir, cfg: PlanConfig = DEFAULT):
    """Test rows per category, and those with a finite model forecast."""
    from ..operators.forecast import model_rows

    rows = model_rows(weekly_demand(spark, sf_dir, cfg.test_cutoff), cfg)
    finite = F.col("model_forecast").isNotNull() & ~F.isnan("model_forecast") & (F.abs("model_forecast") < float("inf"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(finite).alias("n_forecast"))


QUERIES: dict[str, Query] = {
    "weekly_demand": q_weekly_demand,
    "item_info": q_item_info,
    "demand_profile": q_demand_profile,
    "split_profile": q_split_profile,
    "training_set": q_training_set,
    "testing_set": q_testing_set,
    "policy_params": q_policy_params,
    "baseline_plan": q_baseline_plan,
    "calendar_features": q_calendar_features,
    "signals": q_signals,
    "lag_features": q_lag_features,
    "moving_average": q_moving_average,
    "training_matrix": q_training_matrix,
    "test_features_actuals": q_test_features_actuals,
    "test_features_carry": q_test_features_carry,
    "context_plan": q_context_plan,
    "settle_baseline": q_settle_baseline,
    "settle_context": q_settle_context,
    "kpi_baseline": q_kpi_baseline,
    "kpi_overall": q_kpi_overall,
    "plan_comparison": q_plan_comparison,
    "category_comparison": q_category_comparison,
    "forecast_accuracy": q_forecast_accuracy,
    "product_comparison": q_product_comparison,
    "stockouts_inventory_over_time": q_stockouts_inventory_over_time,
    "forecast_comparison": q_forecast_comparison,
    "service_level_by_category": q_service_level_by_category,
    "cost_by_category": q_cost_by_category,
    "weekly_inventory": q_weekly_inventory,
    "weekly_stockouts": q_weekly_stockouts,
    "weekly_demand_vs_forecast": q_weekly_demand_vs_forecast,
    "calendar_spine": q_calendar_spine,
    "densified_demand": q_densified_demand,
    "scenario_demand": q_scenario_demand,
    "scenario_lead_time": q_scenario_lead_time,
    "scenario_comparison": q_scenario_comparison,
    "contract_report": q_contract_report,
    "buffer_coverage": q_buffer_coverage,
    "context_plan_buffers": q_context_plan_buffers,
    "service_level_policies": q_service_level_policies,
    "refreshed_stats": q_refreshed_stats,
    "stored_weeks": q_stored_weeks,
    "gbt_forecast": q_gbt_forecast,
    "context_plan_gbt": q_context_plan_gbt,
    "gbt_accuracy": q_gbt_accuracy,
    "model_inputs": q_model_inputs,
    "assembled_features": q_assembled_features,
    "forecast_coverage": q_forecast_coverage,
}
