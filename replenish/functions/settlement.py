"""Single-period settlement of a plan row against actual demand.

Every period starts from its own opening stock (the plan's safety stock);
nothing is carried to the next period, so settlement is a pure row-wise
projection. Columns that depend on the opening stock or the demand are NULL
when either is NULL: Spark's ``least``/``greatest`` skip NULLs, so each one
is guarded explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HOLDING_RATE, ORDER_COST, PERIODS_PER_YEAR

SETTLEMENT_COLUMNS = (
    "ending_inventory",
    "fulfilled_demand",
    "stockout",
    "holding_cost",
    "stockout_cost",
    "order_cost",
    "total_cost",
    "service_level",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def settlement_columns(
    start="starting_inventory",
    demand="actual_demand",
    order_qty="order_quantity",
    unit_cost="unit_cost",
    multiplier="stockout_cost_multiplier",
    holding_rate: float = HOLDING_RATE,
    periods: int = PERIODS_PER_YEAR,
    order_cost: float = ORDER_COST,
) -> dict[str, Column]:
    """Ordered mapping name -> Column for the eight settlement outputs."""
    s, d = _c(start), _c(demand)
    known = s.isNotNull() & d.isNotNull()
    zero = F.lit(0.0)

    fulfilled = F.when(known, F.least(s, d))
    stockout = F.when(known, F.greatest(zero, d - fulfilled))
    ending = F.when(known, F.greatest(zero, s - d))
    holding = ending * (_c(unit_cost) * F.lit(holding_rate) / F.lit(periods))
    short_cost = stockout * _c(unit_cost) * _c(multiplier)
    ordering = F.when(_c(order_qty) > 0, F.lit(float(order_cost))).otherwise(zero)
    service = F.when(known, F.when(d > 0, fulfilled / d).otherwise(F.lit(1.0)))
    return {
        "ending_inventory": ending,
        "fulfilled_demand": fulfilled,
        "stockout": stockout,
        "holding_cost": holding,
        "stockout_cost": short_cost,
        "order_cost": ordering,
        "total_cost": holding + short_cost + ordering,
        "service_level": service,
    }
