"""Model tests: the boosted-tree values cannot be checked by SQL."""

import math

import pytest
from pyspark.sql import functions as F

from replenish import session
from replenish.config import DEFAULT
from replenish.operators import features, forecast, panel, split


@pytest.fixture(scope="module")
def preds(inputs_small):
    demand, _ = inputs_small
    return forecast.gbt_forecasts(demand).cache()


def test_one_finite_prediction_per_test_row(inputs_small, preds):
    demand, _ = inputs_small
    test = demand.filter(split.test_filter(DEFAULT))
    assert preds.count() == test.count()
    assert preds.select("product_id", "date").distinct().count() == test.count()
    vals = [r.forecast_demand for r in preds.select("forecast_demand").collect()]
    assert all(v is not None and math.isfinite(v) for v in vals)


def test_forecasts_do_not_depend_on_the_layout(spark, inputs_small):
    demand, _ = inputs_small
    table = forecast.featured(demand).cache()
    test = table.filter(split.test_filter(DEFAULT))
    a, b = (forecast.scored(test, forecast.train_forest(forecast.training_rows(table).repartition(n))) for n in (3, 29))
    both = a.select("product_id", "date", F.col("model_forecast").alias("a")).join(b, ["product_id", "date"])
    assert both.filter("a <> model_forecast").count() == 0 and both.count() == test.count()


def test_withheld_category_has_no_context_plan(spark, inputs_small):
    demand, items = inputs_small
    scored = forecast.model_rows(panel.history_rows(demand, items), categories=["ECONOMY", "no such category"])
    rows = panel.planning_rows(demand, items, scored=scored)
    n = scored.filter("model_forecast is not null").count()
    assert 0 < n < scored.count()
    assert panel.context_from_rows(rows).count() == n
    assert panel.baseline_from_rows(rows).count() == 418
    by = {r.policy: r["count"] for r in panel.policy_panel(demand, items, scored=scored).groupBy("policy").count().collect()}
    assert by == {"Traditional": 418, "Context Aware": n}


def test_null_costs_leave_the_training_rows(spark, inputs_small):
    demand, items = inputs_small
    bare = items.withColumn("unit_cost", F.when(F.col("product_id") % 10 != 0, F.col("unit_cost")))
    rows = panel.history_rows(demand, bare)
    assert rows.filter("unit_cost is null").count() > 0
    n = [forecast.training_rows(forecast.featured(x)).count() for x in (rows, panel.history_rows(demand, items))]
    assert n[0] == n[1] == features.training_matrix(demand.filter(split.train_filter(DEFAULT))).count()


def test_missing_feature_raises(inputs_small):
    demand, _ = inputs_small
    train_ml = features.training_matrix(demand.filter(split.train_filter(DEFAULT)))
    for train in (forecast.train_context_aware_model, forecast.train_forest):
        with pytest.raises(ValueError, match="no_such_feature"):
            train(train_ml, ["month", "no_such_feature"], ["ECONOMY"])


def test_actuals_mode_runs(inputs_small):
    demand, _ = inputs_small
    cfg = DEFAULT.with_(lag_mode="actuals")
    out = forecast.gbt_forecasts(demand, cfg, categories=["ECONOMY"])
    assert out.count() == demand.filter(split.test_filter(cfg) & (F.col("category") == "ECONOMY")).count()
    with pytest.raises(ValueError, match="lag_mode"):
        forecast.featured(demand, DEFAULT.with_(lag_mode="other"))


def test_intermediates_need_a_shared_folder_and_go(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Remote:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Remote())
    with session.scratch():
        df = session.materialize(spark.range(5), "test")
        path = df.inputFiles()[0]
        assert df.count() == 5
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
