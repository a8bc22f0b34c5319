"""The whole planning job: build inputs, plan, settle, compare, persist.

Runs the reference notebook's sequence as a Spark job and writes its twelve
tables (SNK1). Every step reads the table the previous step wrote, so:

* the expensive line-item roll-up runs once, not once per output;
* lineage is cut at each table — a lost executor re-reads a written table
  instead of recomputing from the raw files;
* the tables are the dashboard's datasets (V1-V7 are plain reads of them).

Tables go either to a catalog database (``saveAsTable``; the schema is
created if absent, SRC4) or, with ``path``, to one folder per table.

Command line (SRC5 job parameters)::

    python -m replenish.plans.pipeline --sf-dir /data/tpch --database planning
    python -m replenish.plans.pipeline --sf-dir ... --path /shared/out --format parquet --no-model
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, PlanConfig
from ..operators import compare, panel, split
from ..session import materialize, scratch
from ..sources.tables import load_inputs
from . import views

TABLES = (
    "product_info",
    "supply_chain",
    "training_set",
    "testing_set",
    "traditional_plan",
    "context_aware_plan",
    "traditional_simulation",
    "context_aware_simulation",
    "plan_comparison",
    "category_comparison",
    "forecast_accuracy",
    "product_comparison",
)


@dataclass(frozen=True)
class Output:
    """Where tables go: a catalog database, or a folder of per-table paths.

    In catalog mode with ``buckets``, the product-keyed tables
    (``supply_chain``, ``product_info``, the plans and simulations) are
    bucketed and sorted by ``product_id`` into the same number of buckets, so
    every later per-product window, join and aggregate reads them already
    co-partitioned — no shuffle of the demand rows after they are written.
    ``location`` places a newly created schema (e.g. on shared storage).
    """

    database: str | None = None
    path: str | None = None
    fmt: str = "parquet"
    buckets: int | None = None
    location: str | None = None
    catalog: str | None = None

    def prepare(self, spark: SparkSession) -> None:
        if self.path is not None:
            return
        if self.catalog:
            spark.catalog.setCurrentCatalog(self.catalog)
        if self.database:
            where = f" LOCATION '{self.location}'" if self.location else ""
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self._quoted(self.catalog, self.database)}{where}")

    @staticmethod
    def _quoted(*parts: str | None) -> str:
        return ".".join(f"`{p}`" for p in parts if p)

    def name(self, table: str) -> str:
        return self._quoted(self.catalog if self.database else None, self.database, table)

    def write(self, spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
        """Overwrite ``table`` with ``df`` and return a fresh read of it."""
        w = df.write.mode("overwrite").format(self.fmt)
        if self.path is not None:
            location = f"{self.path.rstrip('/')}/{table}"
            w.save(location)
            return spark.read.format(self.fmt).load(location)
        if self.buckets and "product_id" in df.columns:
            # Dealt by bucket first: one file a bucket, not one a task and bucket.
            w = df.repartition(self.buckets, "product_id").write.mode("overwrite").format(self.fmt)
            w = w.bucketBy(self.buckets, "product_id").sortBy("product_id")
        w.saveAsTable(self.name(table))
        return spark.table(self.name(table))


def run(
    spark: SparkSession,
    demand: DataFrame,
    items: DataFrame,
    out: Output,
    cfg: PlanConfig = DEFAULT,
    use_model: bool = True,
) -> dict[str, DataFrame]:
    """Run every step; return each written table as a DataFrame read back."""
    out.prepare(spark)
    t: dict[str, DataFrame] = {}
    t["product_info"] = out.write(spark, items, "product_info")
    t["supply_chain"] = out.write(spark, demand, "supply_chain")
    demand, items = t["supply_chain"], t["product_info"]

    train, test = split.split_train_test(demand, cfg)
    t["training_set"] = out.write(spark, train, "training_set")
    t["testing_set"] = out.write(spark, test, "testing_set")

    with scratch():
        scored = None
        if use_model:
            from ..operators.forecast import model_rows

            scored = model_rows(panel.history_rows(demand, items, cfg), cfg)
        # Window, join and scoring run once; both plans are selected from the written rows.
        rows = materialize(panel.planning_rows(demand, items, cfg, scored=scored), "planning-rows")
        t["traditional_plan"] = out.write(spark, panel.baseline_from_rows(rows, keep_costs=True), "traditional_plan")
        t["context_aware_plan"] = out.write(spark, panel.context_from_rows(rows, keep_costs=True), "context_aware_plan")

    from ..operators.settle import settle

    t["traditional_simulation"] = out.write(spark, settle(t["traditional_plan"], cfg=cfg), "traditional_simulation")
    t["context_aware_simulation"] = out.write(
        spark, settle(t["context_aware_plan"], cfg=cfg), "context_aware_simulation"
    )

    settled = panel.tag_policies(t["traditional_simulation"], t["context_aware_simulation"])
    plans = panel.tag_policies(t["traditional_plan"], t["context_aware_plan"])
    t["plan_comparison"] = out.write(spark, compare.plan_comparison(settled), "plan_comparison")
    t["category_comparison"] = out.write(spark, compare.category_comparison(settled), "category_comparison")
    t["forecast_accuracy"] = out.write(spark, compare.forecast_accuracy(plans), "forecast_accuracy")
    t["product_comparison"] = out.write(spark, compare.product_comparison(settled, items=items), "product_comparison")
    return t


def dashboard(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The dashboard's datasets over the written tables."""
    settled = panel.tag_policies(tables["traditional_simulation"], tables["context_aware_simulation"])
    demand = tables["supply_chain"]
    fc = demand.join(
        tables["context_aware_plan"].select("date", "product_id", "forecast_demand")
        .withColumnRenamed("forecast_demand", "c_forecast"),
        ["date", "product_id"],
        "left",
    ).join(
        tables["traditional_plan"].select("date", "product_id", "forecast_demand")
        .withColumnRenamed("forecast_demand", "t_forecast"),
        ["date", "product_id"],
        "left",
    )
    forecast_comparison = fc.selectExpr(
        "date AS Date", "product_id AS Product", "category AS Category", "demand AS Demand",
        "c_forecast AS Context_Aware_Forecast", "t_forecast AS Traditional_Forecast",
    )
    out = {name: tables[name] for name in (
        "category_comparison", "context_aware_plan", "forecast_accuracy", "plan_comparison",
        "product_comparison", "supply_chain", "traditional_plan")}
    out["stockouts_and_inventory_over_time"] = views.stockouts_inventory_over_time(settled)
    out["forecast_comparison"] = forecast_comparison
    out["service_level_by_category"] = views.service_level_by_category(settled)
    out["cost_by_category"] = views.cost_by_category(settled)
    out["weekly_inventory"] = views.weekly_inventory(settled)
    out["weekly_stockouts"] = views.weekly_stockouts(settled)
    out["weekly_demand_vs_forecast"] = views.weekly_forecasts(forecast_comparison)
    return out


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="Run the replenishment planning job.")
    ap.add_argument("--sf-dir", required=True, help="folder with lineitem/orders/part parquet")
    ap.add_argument("--catalog", default=None, help="catalog that holds the database")
    ap.add_argument("--database", default=None, help="catalog database for the output tables")
    ap.add_argument("--path", default=None, help="write tables as folders under this path instead")
    ap.add_argument("--format", default=DEFAULT.table_format)
    ap.add_argument("--buckets", type=int, default=None, help="bucket product tables by product_id")
    ap.add_argument("--train-cutoff", default=DEFAULT.train_cutoff)
    ap.add_argument("--test-cutoff", default=DEFAULT.test_cutoff)
    ap.add_argument("--no-model", action="store_true", help="trailing-mean forecast instead of GBT")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("replenish-pipeline").getOrCreate()
    cfg = DEFAULT.with_(train_cutoff=args.train_cutoff, test_cutoff=args.test_cutoff, table_format=args.format)
    demand, items = load_inputs(spark, args.sf_dir)
    tables = run(spark, demand, items, Output(args.database, args.path, args.format, args.buckets, catalog=args.catalog), cfg, not args.no_model)
    tables["plan_comparison"].show(truncate=False)


if __name__ == "__main__":
    main()
