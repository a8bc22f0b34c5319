"""Model features: calendar, lags, trailing mean, external signals.

The window is partitioned by ``product_id`` alone, the key every later join
and aggregate of the planning steps uses, so the planner can keep one hash
partitioning from the demand roll-up to the settlement. One product holds at
most one row per week, so a window partition is bounded by the length of the
calendar however skewed the sales are.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, PlanConfig
from ..functions.calendar import DEFAULT_SIGNALS, add_signals, calendar_columns
from ..sources.tables import require_columns
from . import split

LAG_COLUMNS = ("lag_demand", "lag_demand_2", "lag_demand_3")
MA_COLUMN = "demand_ma_4"


def product_window():
    return Window.partitionBy("product_id").orderBy("date")


def history_columns(demand: str = "demand") -> dict[str, Column]:
    """Lag 1/2/3 and the mean of the previous four rows (current row excluded)."""
    w = product_window()
    d = F.col(demand)
    return {
        "lag_demand": F.lag(d, 1).over(w),
        "lag_demand_2": F.lag(d, 2).over(w),
        "lag_demand_3": F.lag(d, 3).over(w),
        MA_COLUMN: F.avg(d).over(w.rowsBetween(-4, -1)),
    }


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_columns())


def with_history(df: DataFrame) -> DataFrame:
    return df.withColumns(history_columns())


def training_matrix(
    train: DataFrame,
    signals: Mapping[str, Callable[[], Column]] | None = DEFAULT_SIGNALS,
) -> DataFrame:
    """Training rows with calendar, lag and moving-average features.

    Rows with any NULL (the first three weeks of each product) are dropped;
    signals are attached after the drop, as in the reference notebook.
    """
    out = with_history(with_calendar(train)).na.drop(how="any")
    return add_signals(out, signals) if signals else out


def test_features_actuals(
    test: DataFrame,
    signals: Mapping[str, Callable[[], Column]] | None = DEFAULT_SIGNALS,
) -> DataFrame:
    """Reference behaviour (D11): the lags and the trailing mean of a test row
    are the row's own demand. This leaks the target into the features; kept
    only for like-for-like comparison."""
    d = F.col("demand")
    out = with_calendar(test).withColumns({c: d for c in (*LAG_COLUMNS, MA_COLUMN)})
    return add_signals(out, signals) if signals else out


def test_features_carry(
    demand: DataFrame,
    cfg: PlanConfig = DEFAULT,
    signals: Mapping[str, Callable[[], Column]] | None = DEFAULT_SIGNALS,
) -> DataFrame:
    """True lags for the test window (default mode).

    The window runs over the whole history before the test cutoff, so the
    first test weeks see the last training weeks and later test weeks see
    earlier test actuals. A product with too little history keeps NULLs.
    """
    hist = demand.filter(split.history_filter(cfg))
    out = with_history(with_calendar(hist)).filter(split.test_filter(cfg))
    return add_signals(out, signals) if signals else out


def test_features(
    demand: DataFrame,
    cfg: PlanConfig = DEFAULT,
    signals: Mapping[str, Callable[[], Column]] | None = DEFAULT_SIGNALS,
) -> DataFrame:
    if cfg.lag_mode == "actuals":
        return test_features_actuals(demand.filter(split.test_filter(cfg)), signals)
    if cfg.lag_mode == "carry":
        return test_features_carry(demand, cfg, signals)
    raise ValueError(f"unknown lag_mode {cfg.lag_mode!r}; expected 'carry' or 'actuals'")


def check_features(df: DataFrame, feature_cols) -> None:
    require_columns(df, feature_cols, "DataFrame")
