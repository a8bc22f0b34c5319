"""Calendar features and external signals as Column factories (F6s-F8s, D23, D24).

A signal is any zero-argument callable returning a Column; ``add_signal``
plugs one into a frame (D12). The reference's promo flag is an unseeded
random draw; ours is a deterministic arithmetic hash of (product, day) so a
re-run, a retried task or a second engine gives the same flags.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HOLIDAY_MONTHS

# Fixed values of the promo hash: flag when
# pmod(product_id * 7919 + days_since_1970 * 104729, 1000) < 100  (~10 %).
PROMO_PRODUCT_MULT = 7919
PROMO_DAY_MULT = 104729
PROMO_MODULUS = 1000
PROMO_THRESHOLD = 100

CALENDAR_COLUMNS = ("weekofyear", "month", "dayofweek")


def calendar_columns(date: str = "date") -> dict[str, Column]:
    d = F.col(date)
    return {
        "weekofyear": F.weekofyear(d),
        "month": F.month(d),
        "dayofweek": F.dayofweek(d),
    }


def holiday_flag(month: str = "month") -> Column:
    return F.when(F.col(month).isin(*HOLIDAY_MONTHS), F.lit(1)).otherwise(F.lit(0))


def promo_flag(product_id: str = "product_id", date: str = "date") -> Column:
    days = F.unix_date(F.to_date(F.col(date))).cast("long")
    key = F.col(product_id).cast("long") * F.lit(PROMO_PRODUCT_MULT) + days * F.lit(PROMO_DAY_MULT)
    return F.when(F.pmod(key, F.lit(PROMO_MODULUS)) < PROMO_THRESHOLD, F.lit(1)).otherwise(F.lit(0))


def promo_flag_logic() -> Column:
    return promo_flag()


def holiday_flag_logic() -> Column:
    return holiday_flag()


DEFAULT_SIGNALS: Mapping[str, Callable[[], Column]] = {
    "promo_flag": promo_flag_logic,
    "holiday_flag": holiday_flag_logic,
}


def add_signal(df: DataFrame, name: str, logic: Callable[[], Column]) -> DataFrame:
    """Attach one external signal column."""
    return df.withColumn(name, logic())


def add_signals(df: DataFrame, signals: Mapping[str, Callable[[], Column]] = DEFAULT_SIGNALS) -> DataFrame:
    """Attach several signals in one projection."""
    return df.withColumns({name: logic() for name, logic in signals.items()})
