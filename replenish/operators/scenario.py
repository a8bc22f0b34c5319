"""Apply a what-if scenario to a demand table.

The week index is measured from the first week of the planning calendar,
which is a parameter: no second pass over the demand is needed to find its
bounds. The overlay is a projection in the same stage as the demand rows; a
trend slope per product comes in with one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.scenario import Scenario, scenario_columns, term_columns


def apply_scenario(
    demand: DataFrame,
    scenario: Scenario = Scenario(),
    origin: str = DEFAULT.calendar_start,
    last: str = DEFAULT.calendar_end,
    slopes: DataFrame | None = None,
) -> DataFrame:
    """Scenario effects and the adjusted demand and lead time per row.

    ``origin``/``last``: first and last week of the calendar. ``slopes``:
    (product_id, slope), the trend of each product over the whole calendar;
    products without one, and all products without the table, use ``scenario.trend``.
    """
    t, n = _weeks(origin, last)
    out = demand
    slope = F.lit(scenario.trend)
    if slopes is not None:
        out = out.join(slopes.select("product_id", F.col("slope").alias("_slope")), "product_id", "left")
        slope = F.coalesce("_slope", slope)
    return _adjusted(out.withColumns(scenario_columns(t, n, scenario, slope)).drop("_slope"))


#: Scenarios of one table at most: each multiplies the rows.
MAX_SCENARIOS = 1_000
#: Rows of the term table that may be broadcast, counted first; a larger one is joined by shuffle.
TERM_ROWS = 100_000


def apply_scenarios(
    demand: DataFrame,
    scenarios: DataFrame,
    terms: DataFrame,
    origin: str = DEFAULT.calendar_start,
    last: str = DEFAULT.calendar_end,
) -> DataFrame:
    """``apply_scenario`` for every scenario of a table in one pass: a row a scenario and demand row.

    ``scenarios``: (scenario, shock_start, trend), a row each; ``terms``:
    (scenario, category, seasonal, shock), the terms of a category, which has
    none without a row. Both are data, so a new scenario needs no new plan.
    """
    heads = scenarios.select("scenario", "shock_start", "trend").orderBy("scenario").limit(MAX_SCENARIOS + 1).collect()
    if len(heads) > MAX_SCENARIOS:
        raise ValueError(f"more than {MAX_SCENARIOS} scenarios")
    if len({h.scenario for h in heads}) < len(heads):
        raise ValueError("a scenario is given twice")
    t, n = _weeks(origin, last)
    structs = [F.struct(F.lit(h.scenario).alias("scenario"), F.lit(h.shock_start).alias("shock_start"), F.lit(h.trend).alias("trend")) for h in heads]
    if not structs:
        raise ValueError("no scenario given")
    rows = demand.select("*", F.inline(F.array(*structs)))
    small = terms.count() <= TERM_ROWS
    rows = rows.join(F.broadcast(terms) if small else terms, ["scenario", "category"], "left")
    effects = term_columns(t, n)
    return _adjusted(rows.withColumns(effects)).select("scenario", *demand.columns, *effects, "scenario_demand", "scenario_lead_time")


def _weeks(origin: str, last: str) -> tuple[Column, Column]:
    """Week index of ``date`` and number of weeks of the calendar."""
    t = F.floor(F.datediff(F.to_date("date"), F.lit(origin).cast("date")) / F.lit(7)).cast("double")
    n = (F.floor(F.datediff(F.lit(last).cast("date"), F.lit(origin).cast("date")) / F.lit(7)) + F.lit(1)).cast("double")
    return t, n


def _adjusted(out: DataFrame) -> DataFrame:
    factor = F.lit(1.0) + F.col("seasonal_effect") + F.col("trend_effect") + F.col("shock_effect")
    return out.withColumns(
        {
            "scenario_demand": F.greatest(F.lit(0.0), F.col("demand") * factor),
            "scenario_lead_time": F.greatest(
                F.lit(1.0), F.col("lead_time") * (F.lit(1.0) + F.col("lead_time_disruption"))
            ),
        }
    )
