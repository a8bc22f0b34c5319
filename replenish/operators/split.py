"""Time split and data profiles.

Both sides of the split are plain filters, so Catalyst pushes the date
bounds into whatever produces ``date``. Profiles are one aggregate each and
stay lazy: the caller decides when to run them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PlanConfig


def _ts(value: str):
    return F.lit(value).cast("timestamp_ntz")


def train_filter(cfg: PlanConfig = DEFAULT):
    return F.col("date") < _ts(cfg.train_cutoff)


def test_filter(cfg: PlanConfig = DEFAULT):
    return (F.col("date") >= _ts(cfg.train_cutoff)) & (F.col("date") < _ts(cfg.test_cutoff))


def history_filter(cfg: PlanConfig = DEFAULT):
    """Everything before the end of the test window (train and test)."""
    return F.col("date") < _ts(cfg.test_cutoff)


def split_train_test(demand: DataFrame, cfg: PlanConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Half-open split: train = [-inf, train_cutoff), test = [train_cutoff, test_cutoff)."""
    return demand.filter(train_filter(cfg)), demand.filter(test_filter(cfg))


def split_profile(demand: DataFrame, cfg: PlanConfig = DEFAULT) -> DataFrame:
    """Row count and date range of each side of the split, in one pass."""
    side = F.when(train_filter(cfg), F.lit("train")).when(test_filter(cfg), F.lit("test"))
    return (
        demand.select(side.alias("split"), "date")
        .filter(F.col("split").isNotNull())
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("date").alias("min_date"),
            F.max("date").alias("max_date"),
        )
    )


def demand_profile(demand: DataFrame) -> DataFrame:
    """Rows, date range, distinct products and categories.

    Two plain aggregates instead of two distinct counts (which would expand
    every row threefold): the rows are already partitioned by product, and
    the few category sets are merged from the per-product rows.
    """
    per_product = demand.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("lo"),
        F.max("date").alias("hi"),
        F.array_sort(F.collect_set("category")).alias("cats"),
    )
    return per_product.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.min("lo").alias("min_date"),
        F.max("hi").alias("max_date"),
        F.count("product_id").alias("n_products"),
        F.size(F.array_distinct(F.flatten(F.collect_set("cats")))).cast("long").alias("n_categories"),
    )
