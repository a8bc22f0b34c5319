"""Context-aware demand forecast: boosted trees for each category.

The history is written once, with statistics, costs and features on its
rows. ``boosting`` grows the trees of all categories together from that table,
and one scan scores the test rows with the trees of their category; the
scored rows already carry what the plan needs, so nothing is joined back.
Forecasts do not depend on how the table is laid out.

``train_context_aware_model`` fits Spark ML's regressor per category instead;
its models score in the same single scan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Iterable, Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PlanConfig
from ..functions.calendar import add_signals
from ..session import materialize
from . import boosting, features, split

KEYS = ("product_id", "date", "category")


def assembler(feature_cols) -> VectorAssembler:
    # handleInvalid="keep": a test row whose lag is unknown (carry mode, a
    # product with too little history) gets NaN instead of failing the job.
    return VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")


def _pipeline(feature_cols, cfg: PlanConfig) -> Pipeline:
    gbt = GBTRegressor(
        featuresCol="features",
        labelCol="demand",
        maxDepth=cfg.gbt_max_depth,
        maxIter=cfg.gbt_max_iter,
        seed=cfg.seed,
    )
    return Pipeline(stages=[assembler(feature_cols), gbt])


def featured(rows: DataFrame, cfg: PlanConfig = DEFAULT) -> DataFrame:
    """History rows with all model features; test rows by the lag mode of ``cfg``."""
    out = features.with_history(features.with_calendar(rows))
    if cfg.lag_mode == "actuals":
        own = F.col("demand")
        swap = {c: F.when(split.test_filter(cfg), own).otherwise(F.col(c)) for c in (*features.LAG_COLUMNS, features.MA_COLUMN)}
        out = out.withColumns(swap)
    elif cfg.lag_mode != "carry":
        raise ValueError(f"unknown lag_mode {cfg.lag_mode!r}; expected 'carry' or 'actuals'")
    return add_signals(out)


def training_rows(table: DataFrame, cfg: PlanConfig = DEFAULT, feature_cols: Iterable[str] | None = None) -> DataFrame:
    """Training rows without a NULL in key, label or feature (other columns do not matter, FL4)."""
    return table.filter(split.train_filter(cfg)).na.drop(subset=[*KEYS, "demand", *(feature_cols or cfg.features)])


def train_context_aware_model(
    train_ml: DataFrame,
    feature_cols: Iterable[str] | None = None,
    categories: Iterable[str] | None = None,
    cfg: PlanConfig = DEFAULT,
    parallelism: int = 8,
) -> dict[str, PipelineModel]:
    """Fit assembler + GBT per category; raise ``ValueError`` on missing feature columns.

    ``categories`` limits the models; a category without training rows has none.
    """
    feature_cols = list(feature_cols or cfg.features)
    features.check_features(train_ml, feature_cols)
    present = [r.category for r in train_ml.select("category").distinct().collect()]  # one name a model
    wanted = set(present if categories is None else categories) & {c for c in present if c is not None}
    pipeline = _pipeline(feature_cols, cfg)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(wanted)))) as pool:  # one job stream per category
        fitted = {c: pool.submit(pipeline.fit, train_ml.filter(F.col("category") == c)) for c in sorted(wanted)}
        return {c: f.result() for c, f in fitted.items()}


def train_forest(
    train_ml: DataFrame,
    feature_cols: Iterable[str] | None = None,
    categories: Iterable[str] | None = None,
    cfg: PlanConfig = DEFAULT,
) -> boosting.Forest:
    """The trees of all categories in one training; raise ``ValueError`` on missing feature columns."""
    feature_cols = list(feature_cols or cfg.features)
    features.check_features(train_ml, feature_cols)
    return boosting.fit(train_ml, feature_cols, "demand", categories, cfg.gbt_max_iter, cfg.gbt_max_depth, cfg.gbt_max_bins)


def scored(rows: DataFrame, models: boosting.Forest | Mapping[str, PipelineModel], column: str = "model_forecast") -> DataFrame:
    """``rows`` with the forecast of their category's trees in one scan; NULL where the category has none."""
    if not isinstance(models, boosting.Forest):
        if not models:
            return rows.withColumn(column, F.lit(None).cast("double"))
        names = next(iter(models.values())).stages[0].getInputCols()
        models = boosting.from_pipelines(dict(models), names)
    return boosting.score(rows, models, column)


def get_context_aware_forecast(test_ml: DataFrame, models: boosting.Forest | Mapping[str, PipelineModel]) -> DataFrame:
    """The test rows that a model scores, with ``forecast_demand``."""
    if not (models.categories if isinstance(models, boosting.Forest) else models):
        raise ValueError("no models to score with")
    return scored(test_ml, models, "forecast_demand").filter(F.col("forecast_demand").isNotNull())


def model_rows(rows: DataFrame, cfg: PlanConfig = DEFAULT, categories=None) -> DataFrame:
    """The test rows among the history ``rows``, all columns kept, with ``model_forecast``."""
    table = materialize(featured(rows.filter(split.history_filter(cfg)), cfg), "featured-history")
    return scored(table.filter(split.test_filter(cfg)), train_forest(training_rows(table, cfg), cfg.features, categories, cfg))


def gbt_forecasts(demand: DataFrame, cfg: PlanConfig = DEFAULT, categories=None) -> DataFrame:
    """Per test row (product_id, date, category, demand, lead_time, forecast_demand) from the trees of its category."""
    out = model_rows(demand, cfg, categories).filter(F.col("model_forecast").isNotNull())
    return out.select("product_id", "date", "category", "demand", "lead_time", F.col("model_forecast").alias("forecast_demand"))
