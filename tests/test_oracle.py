"""Every registered query against its SQL oracle (DuckDB) on sf0.001, plus
the pinned settlement numbers of FIXTURES §4."""

import math
import os
import sys

import duckdb
import pytest

from paths import ROOT, SF0001

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as entry  # noqa: E402
from check_oracle import frame_hash  # noqa: E402

from replenish.plans.oracle import oracle_sql  # noqa: E402
from replenish.plans.queries import QUERIES  # noqa: E402

SQL = oracle_sql()
ORACLE_KEYS = sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF0001).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert frame_hash(got) == frame_hash(want)


def test_every_query_has_oracle_or_is_model_based():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    missing = set(QUERIES) - set(SQL)
    assert missing == {"gbt_forecast", "context_plan_gbt", "gbt_accuracy"}


# sf, policy -> rows, service level, stockout frequency, holding, stockout cost, mean ending inventory
PINNED = {
    "Traditional": (418, 0.975381, 0.165072, 35647.82, 1451013.26, 19.503320),
    "Context Aware": (418, 0.990018, 0.076555, 54066.98, 617002.74, 29.576999),
}


def test_pinned_settlement_numbers(spark, inputs_small):
    from pyspark.sql import functions as F

    from replenish.operators.compare import kpi_aggregates
    from replenish.operators.panel import policy_panel

    demand, items = inputs_small
    rows = policy_panel(demand, items).groupBy("policy").agg(F.count(F.lit(1)).alias("n"), *kpi_aggregates())
    got = {r.policy: r for r in rows.collect()}
    for pol, (n, sl, sf, hold, so, inv) in PINNED.items():
        r = got[pol]
        assert r.n == n
        assert math.isclose(round(r.avg_service_level, 6), sl)
        assert math.isclose(round(r.stockout_frequency, 6), sf)
        assert math.isclose(round(r.total_holding_cost, 2), hold)
        assert math.isclose(round(r.total_stockout_cost, 2), so)
        assert math.isclose(round(r.avg_inventory, 6), inv)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r.Metric for r in rows] == ["Total Cost", "Service Level", "Stockout Frequency", "Avg Inventory"]
