"""Planning parameters.

One frozen dataclass carries every knob the planning steps read, so a job
can be re-run with other cutoffs, buffers or cost rates without touching
code. Defaults follow the canonical input contract in FIXTURES.md.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

# Fixed values that results depend on (must stay as written):
#   z-score of the 95 % service level, the one-sided standard-normal quantile
#   1.6448536269514722; annual holding rate 0.25; flat order cost 50;
#   52 weeks per year; adaptive safety factor 1.5 when the period lead time
#   exceeds the training mean, else 1.0.
Z_95 = 1.6448536269514722
HOLDING_RATE = 0.25
ORDER_COST = 50.0
PERIODS_PER_YEAR = 52
ADAPTIVE_FACTOR = 1.5

# Forecast buffer per part type (category) of the test tables.
DEFAULT_BUFFERS = {
    "ECONOMY": 0.15,
    "LARGE": 0.10,
    "MEDIUM": 0.20,
    "PROMO": 0.10,
    "SMALL": 0.05,
    "STANDARD": 0.10,
}

# The ten model features, in the order the model sees them.
DEFAULT_FEATURES = (
    "weekofyear",
    "month",
    "dayofweek",
    "lead_time",
    "lag_demand",
    "lag_demand_2",
    "lag_demand_3",
    "demand_ma_4",
    "promo_flag",
    "holiday_flag",
)

# Holiday months (November, December).
HOLIDAY_MONTHS = (11, 12)


@dataclass(frozen=True)
class PlanConfig:
    train_cutoff: str = "2001-01-01"
    test_cutoff: str = "2001-07-02"
    buffers: Mapping[str, float] = field(
        default_factory=lambda: MappingProxyType(dict(DEFAULT_BUFFERS))
    )
    service_level: float = 0.95
    holding_rate: float = HOLDING_RATE
    order_cost: float = ORDER_COST
    periods_per_year: int = PERIODS_PER_YEAR
    adaptive_factor: float = ADAPTIVE_FACTOR
    features: tuple[str, ...] = DEFAULT_FEATURES
    # "carry": true lags over the whole history (default, no leakage);
    # "actuals": test lags/moving average set to the row's own demand.
    lag_mode: str = "carry"
    gbt_max_depth: int = 5
    gbt_max_iter: int = 10
    gbt_max_bins: int = 32
    seed: int = 42
    # The planning calendar: first and last week (Mondays). Dense panels and
    # scenarios run over it, and demand outside it is an error.
    calendar_start: str = "1995-01-02"
    calendar_end: str = "2001-10-29"
    # Output table format for persisted results ("parquet"; "delta" when the
    # Delta jars are on the classpath).
    table_format: str = "parquet"

    def with_(self, **kw) -> "PlanConfig":
        from dataclasses import replace

        return replace(self, **kw)


DEFAULT = PlanConfig()
