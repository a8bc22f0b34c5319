"""Dashboard result sets (V8-V16) as DataFrames.

The reference serves these as SQL over persisted tables; here each is a
lazy aggregate over the settled policy panel or over the demand table left
joined to both forecasts. The weekly charts wrap a dataset in a second
aggregate on the Monday of the week, as the dashboard widgets do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PlanConfig
from ..operators import compare, panel
from ..sources.tables import week_start


def stockouts_inventory_over_time(settled: DataFrame) -> DataFrame:
    """Per date and policy: total stockout units and mean ending stock (V8)."""
    return settled.groupBy("date", F.col("policy").alias("Simulation")).agg(
        F.sum("stockout").alias("Stockouts"),
        F.avg("ending_inventory").alias("Inventory"),
    ).select("Stockouts", "Inventory", "date", "Simulation")


def forecast_comparison(
    demand: DataFrame, items: DataFrame, cfg: PlanConfig = DEFAULT, forecasts: DataFrame | None = None
) -> DataFrame:
    """Every demand row with both forecasts, NULL outside the test window (V9).

    The reference left-joins the demand table to each persisted plan. Both
    forecasts come from the same window pass over the demand here, so the
    source is read once and only the item keys are joined (see
    ``panel.history_with_forecasts``).
    """
    rows = panel.history_with_forecasts(demand, items, cfg, forecasts)
    return rows.select(
        F.col("date").alias("Date"),
        F.col("product_id").alias("Product"),
        F.col("category").alias("Category"),
        F.col("demand").alias("Demand"),
        F.col("c_forecast").alias("Context_Aware_Forecast"),
        F.col("t_forecast").alias("Traditional_Forecast"),
    )


def service_level_by_category(settled: DataFrame) -> DataFrame:
    """Bar chart data: summed service level of each policy per category."""
    cc = compare.category_comparison(settled)
    return cc.groupBy("category").agg(
        F.sum("Context_Aware_Service_Level").alias("sum_context_aware_service_level"),
        F.sum("Traditional_Service_Level").alias("sum_traditional_service_level"),
    )


def cost_by_category(settled: DataFrame) -> DataFrame:
    """Bar chart data: summed cost of each policy per category."""
    cc = compare.category_comparison(settled)
    return cc.groupBy("category").agg(
        F.sum("Context_Aware_Cost").alias("sum_context_aware_cost"),
        F.sum("Traditional_Cost").alias("sum_traditional_cost"),
    )


def weekly_inventory(settled: DataFrame) -> DataFrame:
    """Line chart data: weekly summed mean inventory per policy."""
    v8 = stockouts_inventory_over_time(settled)
    return v8.groupBy(week_start(F.col("date")).alias("week"), "Simulation").agg(
        F.sum("Inventory").alias("sum_inventory")
    )


def weekly_stockouts(settled: DataFrame) -> DataFrame:
    """Line chart data: weekly stockout units per policy."""
    v8 = stockouts_inventory_over_time(settled)
    return v8.groupBy(week_start(F.col("date")).alias("week"), "Simulation").agg(
        F.sum("Stockouts").alias("sum_stockouts")
    )


def weekly_demand_vs_forecast(
    demand: DataFrame, items: DataFrame, cfg: PlanConfig = DEFAULT, forecasts: DataFrame | None = None
) -> DataFrame:
    """Line chart data: weekly demand and both forecasts; NULL forecasts are skipped."""
    return weekly_forecasts(forecast_comparison(demand, items, cfg, forecasts))


def weekly_forecasts(v9: DataFrame) -> DataFrame:
    """The weekly sums of ``forecast_comparison`` rows."""
    return v9.groupBy(week_start(F.col("Date")).alias("week")).agg(
        F.sum("Demand").alias("sum_demand"),
        F.sum("Context_Aware_Forecast").alias("sum_context_aware_forecast"),
        F.sum("Traditional_Forecast").alias("sum_traditional_forecast"),
    )
