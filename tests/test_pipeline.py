"""The persisted job end to end (SNK1): tables written, read back, consistent."""

import math
import tempfile
import uuid

from pyspark.sql import functions as F

from replenish.plans import pipeline
from replenish.plans.queries import QUERIES
from replenish.sources.tables import load_inputs

from paths import SF0001


def test_pipeline_writes_all_tables_and_matches_panel(spark):
    out = pipeline.Output(path=tempfile.mkdtemp(prefix="replenish-out-"), fmt="parquet")
    demand, items = load_inputs(spark, SF0001)
    tables = pipeline.run(spark, demand, items, out, use_model=False)
    assert set(tables) == set(pipeline.TABLES)
    assert tables["supply_chain"].count() == 5768
    assert tables["traditional_simulation"].count() == tables["context_aware_simulation"].count() == 418
    got = {r.Metric: r for r in tables["plan_comparison"].collect()}
    want = {r.Metric: r for r in QUERIES["plan_comparison"](spark, SF0001).collect()}
    for m, r in want.items():
        assert math.isclose(got[m].Context_Aware, r.Context_Aware, rel_tol=1e-6, abs_tol=1e-6), m
    dash = pipeline.dashboard(tables)
    assert dash["forecast_comparison"].count() == 5768
    assert dash["forecast_comparison"].filter(F.col("Traditional_Forecast").isNotNull()).count() == 418
    assert dash["weekly_inventory"].count() == 52
    v16 = {r.week: r for r in dash["weekly_demand_vs_forecast"].collect()}
    for r in QUERIES["weekly_demand_vs_forecast"](spark, SF0001).collect():
        assert math.isclose(v16[r.week].sum_demand, r.sum_demand, abs_tol=0.01)
        assert math.isclose(v16[r.week].sum_context_aware_forecast or 0, r.sum_context_aware_forecast or 0, abs_tol=0.01)


def test_command_line(spark):
    root = tempfile.mkdtemp(prefix="replenish-cli-")
    pipeline.main(["--sf-dir", SF0001, "--path", root, "--no-model", "--train-cutoff", "2001-01-01"])
    for t in pipeline.TABLES:
        assert spark.read.parquet(f"{root}/{t}").count() > 0
    db = f"replenish_{uuid.uuid4().hex[:8]}"
    try:
        pipeline.main(["--sf-dir", SF0001, "--catalog", "spark_catalog", "--database", db, "--no-model"])
        assert spark.table(f"spark_catalog.{db}.plan_comparison").count() == 4
    finally:
        spark.sql(f"DROP SCHEMA IF EXISTS `{db}` CASCADE")


def test_pipeline_with_model(spark):
    out = pipeline.Output(path=tempfile.mkdtemp(prefix="replenish-out-"), fmt="parquet")
    demand, items = load_inputs(spark, SF0001)
    tables = pipeline.run(spark, demand, items, out, use_model=True)
    assert tables["context_aware_plan"].count() == 418
    assert tables["forecast_accuracy"].count() == 3


def test_bucketed_tables_plan_without_product_shuffle(spark):
    import io
    from contextlib import redirect_stdout

    from replenish.operators import compare, panel

    db = f"replenish_{uuid.uuid4().hex[:8]}"
    out = pipeline.Output(database=db, buckets=8, location=tempfile.mkdtemp(prefix="replenish-db-"))
    demand, items = load_inputs(spark, SF0001)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = pipeline.run(spark, demand, items, out, use_model=False)
        df = compare.plan_comparison(panel.policy_panel(tables["supply_chain"], tables["product_info"]))
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain()
        assert "hashpartitioning(product_id" not in buf.getvalue()
        got = {r.Metric: r.Traditional for r in df.collect()}
        assert math.isclose(got["Service Level"], 0.9753809676701157, rel_tol=1e-12)
        for t in ("supply_chain", "traditional_plan"):
            assert len(tables[t].inputFiles()) <= 8, t  # one file a bucket
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP SCHEMA IF EXISTS `{db}` CASCADE")
