"""Settle plans against actual demand.

Each plan row opens with its safety stock; settlement is a projection, so
it runs inside the same stage as whatever produced the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PlanConfig
from ..functions.settlement import SETTLEMENT_COLUMNS, settlement_columns
from .policy import COST_COLUMNS

SIMULATION_KEYS = ("date", "product_id", "category", "actual_demand")


def settle(plan: DataFrame, items: DataFrame | None = None, cfg: PlanConfig = DEFAULT, keep=()) -> DataFrame:
    """Settle a plan (baseline or context-aware) row by row.

    If the plan already carries ``unit_cost`` and ``stockout_cost_multiplier``
    (plans built with ``keep_costs=True``) no join is made; otherwise the
    costs come from ``items`` by an inner join on ``product_id`` (J4/J5).
    """
    if not all(c in plan.columns for c in COST_COLUMNS):
        if items is None:
            raise ValueError("plan has no cost columns; pass the item master")
        plan = plan.drop(*[c for c in COST_COLUMNS if c in plan.columns]).join(
            items.select("product_id", *COST_COLUMNS), "product_id"
        )
    cols = settlement_columns(
        start=F.col("safety_stock"),
        holding_rate=cfg.holding_rate,
        periods=cfg.periods_per_year,
        order_cost=cfg.order_cost,
    )
    return plan.select(*SIMULATION_KEYS, *keep, *[cols[c].alias(c) for c in SETTLEMENT_COLUMNS])


def simulate_traditional_approach(baseline: DataFrame, items: DataFrame | None = None, cfg: PlanConfig = DEFAULT):
    return settle(baseline, items, cfg)


def simulate_context_aware_approach(context: DataFrame, items: DataFrame | None = None, cfg: PlanConfig = DEFAULT):
    return settle(context, items, cfg)
