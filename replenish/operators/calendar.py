"""Weekly planning calendar and dense product-week panels.

Observed cells are the default everywhere else (most product-weeks have no
sale). The calendar is a parameter (``PlanConfig.calendar_start`` and
``calendar_end``), not a min/max over the demand. The dense panel meets items
and demand on the product alone; in the order of a product's weeks every
observed row expands into itself and the weeks up to the next one, so the
spine is never shuffled and no (product, date) join is needed. A demand row
outside the calendar is an error: a single bad date neither stretches the panel
nor vanishes from it.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PlanConfig


#: Rows of the spine that one task makes, about.
TASK_ROWS = 1_000_000


def _day(value: str) -> Column:
    return F.lit(value).cast("date")


def calendar_spine(items: DataFrame, cfg: PlanConfig = DEFAULT) -> DataFrame:
    """(product_id, category, date): every item in every week of the calendar.

    An item is a few bytes in its file and hundreds of rows here, so the items
    are counted and dealt out by the rows they become, not by their bytes.
    """
    weeks = F.sequence(_day(cfg.calendar_start), _day(cfg.calendar_end), F.expr("INTERVAL 7 DAYS"))
    items = items.select("product_id", "category")
    days = (_dt.date.fromisoformat(cfg.calendar_end) - _dt.date.fromisoformat(cfg.calendar_start)).days
    tasks = -(-items.count() * (days // 7 + 1) // TASK_ROWS)
    if tasks > 1:
        items = items.repartition(tasks)
    rows = items.select("product_id", "category", F.explode(weeks).alias("day"))
    return rows.select("product_id", "category", F.col("day").cast("timestamp_ntz").alias("date"))


def on_calendar(cfg: PlanConfig = DEFAULT) -> Column:
    """Whether ``date`` is a week of the calendar."""
    day = F.to_date("date")
    off = F.datediff(day, _day(cfg.calendar_start))
    return day.between(_day(cfg.calendar_start), _day(cfg.calendar_end)) & (F.pmod(off, F.lit(7)) == 0)


def within_calendar(demand: DataFrame, cfg: PlanConfig = DEFAULT, unsold: bool = False) -> DataFrame:
    """``demand`` as it is; a row outside the calendar, or off its weekdays, raises when it is read.

    ``unsold`` lets rows without date and demand pass (items that never sold).
    """
    fine = on_calendar(cfg)
    if unsold:
        fine = fine | (F.col("date").isNull() & F.col("demand").isNull())
    message = F.concat(F.lit("demand outside the calendar: "), F.coalesce(F.col("date").cast("string"), F.lit("NULL")))
    return demand.withColumn("date", F.when(fine, F.col("date")).otherwise(F.raise_error(message).cast("timestamp_ntz")))


def densify(demand: DataFrame, items: DataFrame, cfg: PlanConfig = DEFAULT, from_first_sale: bool = False) -> DataFrame:
    """Dense panel (product_id, category, date, demand, lead_time, observed).

    Demand is 0 in weeks without a sale; lead time stays NULL there (nothing
    was observed). ``from_first_sale`` starts each product at its first sale and
    leaves out items that never sold.
    """
    seen = within_calendar(demand, cfg).select("product_id", "date", "demand", "lead_time")
    rows = items.select("product_id", "category").join(seen, "product_id", "left")
    return expand_weeks(rows, cfg, from_first_sale)


def expand_weeks(rows: DataFrame, cfg: PlanConfig = DEFAULT, from_first_sale: bool = False) -> DataFrame:
    """The dense panel of ``rows`` (product_id, category, date, demand, lead_time); one row with a NULL date for an item that never sold.

    A product's rows are at most its weeks in the calendar; the window finds them
    where the join or roll-up that made ``rows`` left them.
    """
    from .features import product_window

    w, step = product_window(), F.expr("INTERVAL 7 DAYS")
    day = F.to_date("date")
    rows = rows.withColumns({"_first": F.row_number().over(w) == 1, "_next": F.lead(day).over(w)})
    if from_first_sale:
        rows, begin = rows.filter(F.col("date").isNotNull()), day
    else:
        begin = F.when(F.col("_first"), _day(cfg.calendar_start)).otherwise(day)
    # Rows of one week (no contract forbids them here) do not reach back behind themselves.
    end = F.greatest(F.coalesce(F.date_sub("_next", 7), _day(cfg.calendar_end)), begin)
    weeks = rows.select("*", F.explode(F.sequence(begin, end, step)).alias("_week"))
    observed = F.coalesce(F.col("_week") == day, F.lit(False))
    return weeks.select(
        "product_id",
        "category",
        F.col("_week").cast("timestamp_ntz").alias("date"),
        F.when(observed, F.col("demand")).otherwise(F.lit(0.0)).alias("demand"),
        F.when(observed, F.col("lead_time")).alias("lead_time"),
        observed.alias("observed"),
    )
