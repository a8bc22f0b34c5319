"""Policy comparisons.

All inputs are long frames tagged by ``policy`` (see ``panel``). Every
result is an aggregate with map-side partial aggregation; the pivots from
two policy rows into columns run on those two rows only. Nothing is
collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import error_columns, improvement, point_gain
from .panel import CONTEXT_AWARE, TRADITIONAL

KPI_COLUMNS = (
    "total_holding_cost",
    "total_stockout_cost",
    "total_order_cost",
    "total_cost",
    "avg_service_level",
    "stockout_frequency",
    "avg_inventory",
)


def _stockout_rate() -> Column:
    # Rows with a stockout over all rows (NULL stockouts count as none).
    return F.sum(F.when(F.col("stockout") > 0, F.lit(1)).otherwise(F.lit(0))) / F.count(F.lit(1))


def kpi_aggregates() -> list[Column]:
    return [
        F.sum("holding_cost").alias("total_holding_cost"),
        F.sum("stockout_cost").alias("total_stockout_cost"),
        F.sum("order_cost").alias("total_order_cost"),
        F.sum("total_cost").alias("total_cost"),
        F.avg("service_level").alias("avg_service_level"),
        _stockout_rate().alias("stockout_frequency"),
        F.avg("ending_inventory").alias("avg_inventory"),
    ]


def performance_metrics(settled: DataFrame) -> DataFrame:
    """Overall KPIs per policy (D18): one row per policy."""
    return settled.groupBy("policy").agg(*kpi_aggregates())


def _pivot_two(df: DataFrame, metrics) -> DataFrame:
    """One row holding ``t_<m>`` and ``c_<m>`` for each metric of a per-policy frame."""
    out = []
    for m in metrics:
        out.append(F.max(F.when(F.col("policy") == TRADITIONAL, F.col(m))).alias(f"t_{m}"))
        out.append(F.max(F.when(F.col("policy") == CONTEXT_AWARE, F.col(m))).alias(f"c_{m}"))
    return df.agg(*out)


def _metric_table(wide: DataFrame, rows) -> DataFrame:
    """Stack (label, metric, kind) triples into Metric/Traditional/Context_Aware/Improvement_Percent."""
    args = [F.lit(len(rows))]
    for label, m, kind in rows:
        t, c = F.col(f"t_{m}"), F.col(f"c_{m}")
        gain = point_gain(t, c) if kind == "points" else improvement(t, c)
        args += [F.lit(label), t, c, gain]
    return wide.select(F.stack(*args).alias("Metric", "Traditional", "Context_Aware", "Improvement_Percent"))


COMPARISON_ROWS = (
    ("Total Cost", "total_cost", "percent"),
    ("Service Level", "avg_service_level", "points"),
    ("Stockout Frequency", "stockout_frequency", "percent"),
    ("Avg Inventory", "avg_inventory", "percent"),
)


def plan_comparison(settled: DataFrame) -> DataFrame:
    """Four-row KPI comparison (D19). Service level gains are percentage
    points; the other rows are relative reductions in percent."""
    wide = _pivot_two(performance_metrics(settled), [m for _, m, _ in COMPARISON_ROWS])
    return _metric_table(wide, COMPARISON_ROWS)


def category_comparison(settled: DataFrame) -> DataFrame:
    """Per-category service level and cost of both policies (D20), one pass.

    A category present under only one policy is dropped, as the reference's
    inner join of the two per-category frames does.
    """
    is_t = F.col("policy") == TRADITIONAL
    is_c = F.col("policy") == CONTEXT_AWARE
    agg = settled.groupBy("category").agg(
        F.avg(F.when(is_t, F.col("service_level"))).alias("Traditional_Service_Level"),
        F.avg(F.when(is_c, F.col("service_level"))).alias("Context_Aware_Service_Level"),
        F.sum(F.when(is_t, F.col("total_cost"))).alias("Traditional_Cost"),
        F.sum(F.when(is_c, F.col("total_cost"))).alias("Context_Aware_Cost"),
        F.count_if(is_t).alias("_n_t"),
        F.count_if(is_c).alias("_n_c"),
    )
    return agg.filter((F.col("_n_t") > 0) & (F.col("_n_c") > 0)).select(
        "category",
        "Traditional_Service_Level",
        "Context_Aware_Service_Level",
        point_gain(F.col("Traditional_Service_Level"), F.col("Context_Aware_Service_Level")).alias(
            "Service_Level_Improvement"
        ),
        "Traditional_Cost",
        "Context_Aware_Cost",
        improvement(F.col("Traditional_Cost"), F.col("Context_Aware_Cost")).alias("Cost_Reduction"),
    )


ACCURACY_ROWS = (("MAE", "MAE", "percent"), ("RMSE", "RMSE", "percent"), ("MAPE", "MAPE", "percent"))


def accuracy_metrics(plans: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE per policy over a long frame of plans."""
    errs = plans.withColumns(error_columns())
    return errs.groupBy("policy").agg(
        F.avg("error").alias("MAE"),
        F.sqrt(F.avg("squared_error")).alias("RMSE"),
        F.avg("percentage_error").alias("MAPE"),
    )


def forecast_accuracy(plans: DataFrame) -> DataFrame:
    """Three-row forecast error comparison."""
    wide = _pivot_two(accuracy_metrics(plans), ["MAE", "RMSE", "MAPE"])
    return _metric_table(wide, ACCURACY_ROWS)


def product_costs(settled: DataFrame) -> DataFrame:
    """Total cost of each product under both policies, with the saving (A4, J7); one row a product."""
    is_t = F.col("policy") == TRADITIONAL
    is_c = F.col("policy") == CONTEXT_AWARE
    agg = settled.groupBy("product_id").agg(
        F.min("category").alias("category"),
        F.sum(F.when(is_t, F.col("total_cost"))).alias("traditional_cost"),
        F.sum(F.when(is_c, F.col("total_cost"))).alias("context_cost"),
        F.count_if(is_t).alias("_n_t"),
        F.count_if(is_c).alias("_n_c"),
    )
    saving = F.col("traditional_cost") - F.col("context_cost")
    return agg.filter((F.col("_n_t") > 0) & (F.col("_n_c") > 0)).select(
        "product_id",
        "traditional_cost",
        "context_cost",
        "category",
        saving.alias("cost_saving"),
        (F.try_divide(saving, F.col("traditional_cost")) * F.lit(100.0)).alias("saving_percentage"),
    )


def product_comparison(settled: DataFrame, top_n: int = 10, items: DataFrame | None = None) -> DataFrame:
    """The ``top_n`` products with the largest saving.

    With ``items`` the category is the item master's, looked up for the
    ``top_n`` rows only (J8); otherwise it is that of the settled rows.

    A top-k report: ``orderBy(...).limit`` plans as TakeOrderedAndProject,
    a per-partition top-k and one merge of ``top_n`` rows per partition.
    ``product_id`` breaks ties so the result is deterministic.
    """
    order = (F.desc("cost_saving"), F.asc("product_id"))
    top = product_costs(settled).orderBy(*order).limit(top_n)
    if items is None:
        return top
    columns = top.columns
    named = F.broadcast(top.drop("category")).join(items.select("product_id", "category"), "product_id")  # top_n rows
    return named.select(*columns).orderBy(*order)
