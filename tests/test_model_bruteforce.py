"""Model queries against a brute-force pandas recomputation on sf0.001.

The boosted-tree forecasts themselves have no SQL oracle, but everything
downstream of them does not depend on Spark: given the forecasts, the
context-aware plan and the accuracy table are recomputed here row by row in
pandas from the raw parquet files and compared.
"""

import math

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from replenish.config import DEFAULT, Z_95

from paths import SF0001


@pytest.fixture(scope="module")
def demand_pd():
    li = pd.read_parquet(f"{SF0001}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"])
    od = pd.read_parquet(f"{SF0001}/orders.parquet", columns=["o_orderkey", "o_orderdate"])
    pt = pd.read_parquet(f"{SF0001}/part.parquet", columns=["p_partkey", "p_type", "p_retailprice"])
    m = li.merge(od, left_on="l_orderkey", right_on="o_orderkey")
    ship = m.l_shipdate.dt.normalize()
    m["date"] = ship - pd.to_timedelta(ship.dt.weekday, unit="D")
    gap = (ship - m.o_orderdate.dt.normalize()).dt.days
    m["gap"] = (gap % 49) / 8.0
    w = m.groupby(["l_partkey", "date"], as_index=False).agg(demand=("l_quantity", "sum"), gap=("gap", "max"))
    w = w.merge(pt, left_on="l_partkey", right_on="p_partkey")
    w["lead_time"] = np.maximum(1.0, w.gap)
    return w.rename(columns={"l_partkey": "product_id", "p_type": "category", "p_retailprice": "unit_cost"})


@pytest.fixture(scope="module")
def forecasts(spark):
    return entry.queries()["gbt_forecast"](spark, SF0001).toPandas()


def _params(demand_pd):
    train = demand_pd[demand_pd.date < pd.Timestamp(DEFAULT.train_cutoff)]
    g = train.groupby("product_id").agg(
        demand_avg=("demand", "mean"), demand_std=("demand", "std"), lead_time_avg=("lead_time", "mean")
    )
    g["safety_stock"] = Z_95 * g.demand_std * np.sqrt(g.lead_time_avg)
    return g.reset_index()


def test_context_plan_gbt_equals_bruteforce(spark, demand_pd, forecasts):
    got = entry.queries()["context_plan_gbt"](spark, SF0001).toPandas()
    p = forecasts.merge(_params(demand_pd), on="product_id")
    buf = p.category.map(dict(DEFAULT.buffers))
    factor = np.where(p.lead_time > p.lead_time_avg, DEFAULT.adaptive_factor, 1.0)
    p["safety"] = p.safety_stock * factor
    p["required"] = p.forecast_demand * (1 + buf) * p.lead_time + p.safety
    p["order"] = np.where(p.required > 0, p.required, 0.0)
    j = got.merge(p, on=["product_id", "date"], suffixes=("", "_bf"))
    assert len(j) == len(got) == len(forecasts)
    for a, b in (("safety_stock", "safety"), ("required_inventory", "required"), ("order_quantity", "order")):
        assert np.allclose(j[a], j[b], rtol=1e-6, atol=1e-5), a


def test_gbt_accuracy_equals_bruteforce(spark, demand_pd, forecasts):
    got = {r.Metric: r for r in entry.queries()["gbt_accuracy"](spark, SF0001).collect()}
    p = forecasts.merge(_params(demand_pd), on="product_id")
    out = {}
    for tag, f in (("t", p.demand_avg), ("c", p.forecast_demand)):
        err = (f - p.demand).abs()
        out[tag] = {
            "MAE": err.mean(),
            "RMSE": math.sqrt(((f - p.demand) ** 2).mean()),
            "MAPE": np.where(p.demand != 0, err / p.demand, 0.0).mean(),
        }
    for m in ("MAE", "RMSE", "MAPE"):
        assert math.isclose(got[m].Traditional, round(out["t"][m], 6), abs_tol=2e-6), m
        assert math.isclose(got[m].Context_Aware, round(out["c"][m], 6), abs_tol=2e-6), m
        assert math.isclose(got[m].Improvement_Percent, (1 - out["c"][m] / out["t"][m]) * 100, abs_tol=1e-5), m
