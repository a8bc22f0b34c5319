"""Both policies planned and settled in one pass over the demand history.

The reference builds the baseline and the context-aware plan separately:
per-product statistics by a group-by, joined back to the test rows, each
plan joined to the item master, settled, and aggregated — every step twice,
each re-reading the source. Here one window over the history (partitioned
by product, ordered by date) yields in a single sort both the lag features
and, through whole-partition frames restricted to training rows, the
per-product statistics. The test rows are then joined to the item costs
once, both policies are computed side by side as columns, and a ``stack``
turns them into a long frame tagged by ``policy``. Every comparison
(D18-D22, V8-V16) is a single aggregate over that frame, so the expensive
upstream (the line-item roll-up) is read once per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, PlanConfig
from ..functions import policy_math as pm
from ..functions.settlement import SETTLEMENT_COLUMNS, settlement_columns
from . import features, split
from .policy import (
    BASELINE_PLAN_COLUMNS,
    CONTEXT_PLAN_COLUMNS,
    COST_COLUMNS,
    baseline_columns,
    context_columns,
    with_buffers,
)

TRADITIONAL = "Traditional"
CONTEXT_AWARE = "Context Aware"
POLICIES = (TRADITIONAL, CONTEXT_AWARE)

PANEL_KEYS = ("date", "product_id", "category", "actual_demand", "lead_time")
PLAN_VALUES = ("forecast_demand", "safety_stock", "order_quantity", "required_inventory")


def training_stats_columns(cfg: PlanConfig = DEFAULT) -> dict[str, Column]:
    """Per-product training statistics as whole-partition window aggregates.

    Same values as ``policy.product_stats`` (A1) but attached to every
    history row without a group-by and a join back.
    """
    whole = features.product_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_train = split.train_filter(cfg)
    d = F.when(is_train, F.col("demand"))
    lt = F.when(is_train, F.col("lead_time"))
    return {
        "demand_avg": F.avg(d).over(whole),
        "demand_std": F.stddev_samp(d).over(whole),
        "lead_time_avg": F.avg(lt).over(whole),
        "n_train": F.count(F.when(is_train, F.lit(1))).over(whole),
    }


def planning_rows(
    demand: DataFrame,
    items: DataFrame,
    cfg: PlanConfig = DEFAULT,
    forecasts: DataFrame | None = None,
    scored: DataFrame | None = None,
    buffers: DataFrame | None = None,
    default_buffer: float | None = None,
) -> DataFrame:
    """One row per test product-week with both policies side by side.

    ``forecasts`` (product_id, date, forecast_demand) is a context-aware
    forecast from elsewhere; ``scored`` are the rows of ``history_rows`` that
    the boosted-tree model scored (``forecast.model_rows``), which need no
    join. In both cases a row without a forecast has no context-aware plan
    (``has_context`` is false); its baseline stays. Without either, the
    trailing four-week mean over the whole history is used (deterministic), and
    a product with no earlier week falls back to its training mean.

    A product without training rows, or missing from ``items``, gets no
    rows — the inner-join semantics of the reference's parameter table.
    When ``demand`` already carries the item costs (attached from the same
    item record, ``weekly_demand(with_costs=True)``) no item join is made.
    ``buffers`` is a dimension table (category, buffer) in place of the
    configured mapping; ``default_buffer`` serves categories without a row.
    """
    own = forecasts is None and scored is None
    if scored is not None:
        rows = scored.filter(split.test_filter(cfg) & (F.col("n_train") > 0))
    else:
        cols = training_stats_columns(cfg)
        if own:
            cols["model_forecast"] = features.history_columns()[features.MA_COLUMN]
        hist = demand.filter(split.history_filter(cfg))
        rows = hist.withColumns(cols).filter(split.test_filter(cfg) & (F.col("n_train") > 0))
    if forecasts is not None:
        rows = rows.join(
            forecasts.select("product_id", "date", F.col("forecast_demand").alias("model_forecast")),
            ["product_id", "date"],
            "left",
        )
    if not all(c in rows.columns for c in COST_COLUMNS):
        rows = rows.join(items.select("product_id", *COST_COLUMNS), "product_id")
    rows = rows.withColumnRenamed("demand", "actual_demand").withColumns(
        {
            "eoq": pm.eoq("demand_avg", "unit_cost", cfg.holding_rate, cfg.order_cost, cfg.periods_per_year),
            "safety_stock": pm.safety_stock("demand_std", "lead_time_avg", cfg.service_level),
        }
    )
    base = baseline_columns()
    rows = rows.withColumns(
        {
            "reorder_point": pm.reorder_point("demand_avg", "lead_time_avg", "safety_stock"),
            "t_forecast": base["forecast_demand"],
            "t_required": base["required_inventory"],
            "t_order": base["order_quantity"],
            "forecast_demand": F.coalesce(F.col("model_forecast"), F.col("demand_avg")) if own else F.col("model_forecast"),
            "has_context": F.lit(True) if own else F.col("model_forecast").isNotNull(),
        }
    )
    if buffers is not None:
        rows = with_buffers(rows, buffers, default_buffer)
    ctx = context_columns(cfg, buffer=None if buffers is None else F.col("buffer"))
    return rows.withColumns(
        {
            "c_forecast": F.col("forecast_demand"),
            "c_safety": ctx["adaptive_safety_stock"],
            "c_required": ctx["required_inventory"],
            "c_order": ctx["order_quantity"],
        }
    )


def history_rows(demand: DataFrame, items: DataFrame, cfg: PlanConfig = DEFAULT) -> DataFrame:
    """The history with training statistics and item costs on every row: what the model path writes once."""
    rows = demand.filter(split.history_filter(cfg)).withColumns(training_stats_columns(cfg))
    if all(c in rows.columns for c in COST_COLUMNS):
        return rows
    return rows.join(items.select("product_id", *COST_COLUMNS), "product_id")


def history_with_forecasts(
    demand: DataFrame, items: DataFrame, cfg: PlanConfig = DEFAULT, forecasts: DataFrame | None = None
) -> DataFrame:
    """Every demand row with both forecasts; NULL where no plan exists.

    ``forecasts`` (product_id, date, forecast_demand), e.g. the model's,
    replace the deterministic context-aware forecast.

    A row has a plan when it lies in the test window and its product has
    training rows and an item record. One window pass over the demand and a
    left join to the item keys — the source is read once, where joining the
    demand to separately built plans would read it twice.
    """
    cols = training_stats_columns(cfg)
    cols["model_forecast"] = features.history_columns()[features.MA_COLUMN]
    rows = demand.withColumns(cols)
    planned = split.test_filter(cfg) & (F.col("n_train") > 0)
    if not all(c in demand.columns for c in COST_COLUMNS):
        keys = items.select("product_id", F.lit(True).alias("_has_item"))
        rows = rows.join(keys, "product_id", "left")
        planned = planned & F.col("_has_item").isNotNull()
    context = F.coalesce(F.col("model_forecast"), F.col("demand_avg"))
    if forecasts is not None:
        given = forecasts.select("product_id", "date", F.col("forecast_demand").alias("_given"))
        rows = rows.join(given, ["product_id", "date"], "left")
        context = F.col("_given")
    return rows.withColumns(
        {
            "t_forecast": F.when(planned, F.col("demand_avg")),
            "c_forecast": F.when(planned, context),
        }
    )


def baseline_from_rows(rows: DataFrame, keep_costs: bool = False) -> DataFrame:
    """The traditional plan (D8 columns) out of ``planning_rows``."""
    out = rows.select(
        *[
            {
                "forecast_demand": F.col("t_forecast"),
                "order_quantity": F.col("t_order"),
                "required_inventory": F.col("t_required"),
            }.get(c, F.col(c)).alias(c)
            for c in BASELINE_PLAN_COLUMNS
        ],
        *(COST_COLUMNS if keep_costs else ()),
    )
    return out


def context_from_rows(rows: DataFrame, keep_costs: bool = False) -> DataFrame:
    """The context-aware plan (D14 columns) out of ``planning_rows``; rows without a forecast have none."""
    return rows.filter("has_context").select(
        *[
            {
                "forecast_demand": F.col("c_forecast"),
                "safety_stock": F.col("c_safety"),
                "order_quantity": F.col("c_order"),
                "required_inventory": F.col("c_required"),
            }.get(c, F.col(c)).alias(c)
            for c in CONTEXT_PLAN_COLUMNS
        ],
        *(COST_COLUMNS if keep_costs else ()),
    )


def policy_panel(
    demand: DataFrame,
    items: DataFrame,
    cfg: PlanConfig = DEFAULT,
    forecasts: DataFrame | None = None,
    scored: DataFrame | None = None,
) -> DataFrame:
    """Long frame: one row per (policy, product, week), planned and settled."""
    rows = planning_rows(demand, items, cfg, forecasts, scored)
    stacked = rows.select(
        *PANEL_KEYS,
        *COST_COLUMNS,
        "has_context",
        F.stack(
            F.lit(2),
            F.lit(TRADITIONAL), "t_forecast", "safety_stock", "t_order", "t_required",
            F.lit(CONTEXT_AWARE), "c_forecast", "c_safety", "c_order", "c_required",
        ).alias("policy", *PLAN_VALUES),
    ).filter((F.col("policy") == TRADITIONAL) | F.col("has_context")).drop("has_context")
    cols = settlement_columns(
        start=F.col("safety_stock"),
        holding_rate=cfg.holding_rate,
        periods=cfg.periods_per_year,
        order_cost=cfg.order_cost,
    )
    return stacked.withColumns({c: cols[c] for c in SETTLEMENT_COLUMNS})


def tag_policies(traditional: DataFrame, context: DataFrame) -> DataFrame:
    """Long frame from two separately settled (or planned) frames."""
    return traditional.withColumn("policy", F.lit(TRADITIONAL)).unionByName(
        context.withColumn("policy", F.lit(CONTEXT_AWARE)), allowMissingColumns=True
    )
