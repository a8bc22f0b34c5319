"""Forecast-error columns (D21): absolute, squared and relative error.

A zero actual counts as zero relative error, as in the reference, so MAPE
is averaged over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_columns(forecast: str = "forecast_demand", actual: str = "actual_demand") -> dict[str, Column]:
    f, a = F.col(forecast), F.col(actual)
    diff = f - a
    return {
        "error": F.abs(diff),
        "squared_error": diff * diff,
        "percentage_error": F.when(a != 0, F.abs(diff) / a).otherwise(F.lit(0.0)),
    }


def improvement(traditional: Column, context: Column) -> Column:
    """Relative reduction in percent: (1 - c / t) * 100; NULL when t is 0."""
    return (F.lit(1.0) - F.try_divide(context, traditional)) * F.lit(100.0)


def point_gain(traditional: Column, context: Column) -> Column:
    """Absolute gain in percentage points: (c - t) * 100."""
    return (context - traditional) * F.lit(100.0)
