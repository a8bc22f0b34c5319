"""Readers for the input tables and the two canonical planning inputs.

Canonical contract (FIXTURES.md §2)::

    demand(product_id long, category string, date timestamp_ntz,
           demand double, lead_time double)      -- one row per product-week
    items (product_id long, category string, unit_cost double,
           stockout_cost_multiplier double)      -- one row per product

``weekly_demand`` and ``items_from_parts`` build them from the order,
line-item and part tables; ``read_canonical`` accepts a user's own tables.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, PlanConfig

DEMAND_COLUMNS = ("product_id", "category", "date", "demand", "lead_time")
ITEM_COLUMNS = ("product_id", "category", "unit_cost", "stockout_cost_multiplier")

# Fixed values of the line-item adapter: the order-to-ship gap is folded
# into 0..48 days (mod 49) and read in units of 8 days, floored at one week.
LEAD_GAP_MODULUS = 49
LEAD_GAP_UNIT_DAYS = 8.0
MIN_LEAD_TIME = 1.0
# Fixed values of the item adapter: multiplier = 1.5 + (p_partkey mod 36) / 10.
MULTIPLIER_BASE = 1.5
MULTIPLIER_MODULUS = 36


# Columns the adapters read. Declaring them skips schema inference (a job
# per read here, a footer scan over many files on a cluster) and reads only
# these columns from the Parquet files.
INPUT_SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_quantity double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_orderdate timestamp_ntz",
    "part": "p_partkey long, p_type string, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; a missing column raises (a declared schema alone would read it as NULL)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = INPUT_SCHEMAS.get(name)
    if not schema:
        return spark.read.parquet(path)
    declared = spark.read.schema(schema).parquet(path)
    require_columns(spark.read.parquet(path), declared.columns, path)  # reads one footer
    return declared


def first_monday_on_or_after(day: str) -> _dt.datetime:
    """Smallest week start ``m`` with week_start(t) < cutoff  <=>  t < m."""
    t = _dt.datetime.fromisoformat(day)
    monday = _dt.datetime.combine((t - _dt.timedelta(days=t.weekday())).date(), _dt.time())
    return monday if monday == t else monday + _dt.timedelta(days=7)


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the ISO week holding ``ts`` as TIMESTAMP_NTZ.

    Goes through DATE so the result does not depend on the session time
    zone (``date_trunc`` on a timestamp would).
    """
    return F.trunc(F.to_date(ts), "week").cast("timestamp_ntz")


def lead_time_of(gap_weeks: Column) -> Column:
    """The lead time of a week from its longest order-to-ship gap, at least MIN_LEAD_TIME."""
    return F.greatest(F.lit(MIN_LEAD_TIME), gap_weeks)


def weekly_totals(spark: SparkSession, sf_dir: str, before: str | None = None, since: str | None = None) -> DataFrame:
    """(product_id, date, demand, gap_weeks): the roll-up of the line items alone; bounds as in ``weekly_demand``."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    if before is not None:
        bound = first_monday_on_or_after(before).isoformat(sep=" ")
        li = li.filter(F.col("l_shipdate") < F.lit(bound).cast("timestamp_ntz"))
    if since is not None:
        bound = first_monday_on_or_after(since).isoformat(sep=" ")
        li = li.filter(F.col("l_shipdate") >= F.lit(bound).cast("timestamp_ntz"))
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")

    gap_days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    lines = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("l_partkey").alias("product_id"),
        week_start(F.col("l_shipdate")).alias("date"),
        F.col("l_quantity"),
        (F.pmod(gap_days, F.lit(LEAD_GAP_MODULUS)) / F.lit(LEAD_GAP_UNIT_DAYS)).alias("gap_weeks"),
    )
    return lines.groupBy("product_id", "date").agg(
        F.sum("l_quantity").alias("demand"),
        F.max("gap_weeks").alias("gap_weeks"),
    )


def weekly_demand(
    spark: SparkSession,
    sf_dir: str,
    before: str | None = None,
    with_costs: bool = False,
    since: str | None = None,
    every_part: bool = False,
) -> DataFrame:
    """Weekly demand and lead time per part from the line items.

    ``before`` (a date) keeps only weeks starting before it, ``since`` only
    weeks starting on or after it. Each bound is
    turned into an equivalent one on the raw ship date, which Catalyst pushes
    into the Parquet scan (row groups past it are skipped); a filter on the
    truncated week alone could not be pushed.

    ``with_costs`` also carries the item costs (``unit_cost``,
    ``stockout_cost_multiplier``) from the same part row, so planning needs
    no second scan and shuffle of the part table to attach them. ``every_part``
    also gives one row with NULL date, demand and lead time for a part that never sold.

    Plan shape, chosen for skew: line items join orders on the order key
    (sort-merge; AQE splits a hot order), then the rows are combined map-side
    into (part, week) before the shuffle. Only after that is the part type
    attached, so the part join sees at most one row per part and week — a
    part holding a third of all lines cannot overload a task.
    """
    weekly = weekly_totals(spark, sf_dir, before, since)
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_type", *(["p_retailprice"] if with_costs else []))
    costs = [_unit_cost(), _multiplier()] if with_costs else []
    lead = lead_time_of(F.col("gap_weeks"))
    return weekly.join(pt, weekly.product_id == pt.p_partkey, "right" if every_part else "inner").select(
        F.col("p_partkey").alias("product_id") if every_part else F.col("product_id"),
        F.col("p_type").alias("category"),
        "date",
        "demand",
        (F.when(F.col("date").isNotNull(), lead) if every_part else lead).alias("lead_time"),
        *costs,
    )


def _unit_cost() -> Column:
    return F.col("p_retailprice").cast("double").alias("unit_cost")


def _multiplier() -> Column:
    return (F.lit(MULTIPLIER_BASE) + F.pmod("p_partkey", F.lit(MULTIPLIER_MODULUS)) / F.lit(10.0)).alias(
        "stockout_cost_multiplier"
    )


def items_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item master from the part table."""
    pt = table(spark, sf_dir, "part")
    return pt.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        _unit_cost(),
        _multiplier(),
    )


def require_columns(df: DataFrame, columns, what: str = "DataFrame") -> None:
    """Raise ``ValueError`` naming every missing column (FL7)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns in {what}: {missing}")


def canonical_demand(df: DataFrame) -> DataFrame:
    """Validate and type a user demand table to the canonical contract."""
    require_columns(df, DEMAND_COLUMNS, "demand")
    return df.select(
        F.col("product_id").cast("long"),
        F.col("category").cast("string"),
        F.col("date").cast("timestamp_ntz"),
        F.col("demand").cast("double"),
        F.col("lead_time").cast("double"),
    )


def canonical_items(df: DataFrame) -> DataFrame:
    require_columns(df, ITEM_COLUMNS, "items")
    return df.select(
        F.col("product_id").cast("long"),
        F.col("category").cast("string"),
        F.col("unit_cost").cast("double"),
        F.col("stockout_cost_multiplier").cast("double"),
    )


#: The rules of the input contract, by name; ``contract_violations`` counts the breaks of each.
CONTRACT_RULES = (
    "null_key",
    "duplicate_week",
    "several_categories",
    "off_calendar",
    "negative_demand",
    "item_missing",
    "duplicate_item",
)


def contract_violations(demand: DataFrame, items: DataFrame, cfg: PlanConfig = DEFAULT) -> DataFrame:
    """(rule, product_id, n): every product that breaks a rule of the input contract, and how often (X6, FL7).

    One pass: demand and item rows are counted together by product and week
    (map-side first, so a product that holds a third of all rows is one row a
    week and task), then by product, and each count above 0 becomes a tagged row.
    ``n`` counts rows (null_key, off_calendar, negative_demand, item_missing, and
    duplicates beyond the first) or categories beyond the first.
    """
    from ..operators.calendar import on_calendar

    no = F.lit(0).cast("long")
    demand = demand.withColumn("date", F.col("date").cast("timestamp_ntz"))
    below = F.coalesce((F.col("demand") < 0).cast("long"), no) if "demand" in demand.columns else no
    sales = demand.select(
        "product_id",
        "date",
        "category",
        F.lit(1).cast("long").alias("sale"),
        no.alias("item"),
        (F.col("product_id").isNull() | F.col("date").isNull()).cast("long").alias("nulls"),
        (F.col("date").isNotNull() & ~F.coalesce(on_calendar(cfg), F.lit(False))).cast("long").alias("off"),
        below.alias("below"),
    )
    masters = items.select(
        "product_id",
        F.lit(None).cast("timestamp_ntz").alias("date"),
        F.lit(None).cast("string").alias("category"),
        no.alias("sale"),
        F.lit(1).cast("long").alias("item"),
        F.col("product_id").isNull().cast("long").alias("nulls"),
        no.alias("off"),
        no.alias("below"),
    )
    counts = ("sale", "item", "nulls", "off", "below")
    weeks = sales.unionByName(masters).groupBy("product_id", "date", "category").agg(*(F.sum(c).alias(c) for c in counts))
    # A week or category counts once each; both sets are bounded by the calendar and the categories.
    per = weeks.groupBy("product_id").agg(
        *(F.sum(c).alias(c) for c in counts),
        F.size(F.collect_set(F.when(F.col("sale") > 0, F.col("date")))).alias("weeks"),
        F.sum(F.when(F.col("date").isNotNull(), F.col("sale")).otherwise(no)).alias("dated"),
        F.size(F.collect_set(F.when(F.col("sale") > 0, F.col("category")))).alias("categories"),
    )
    known = F.col("product_id").isNotNull()
    broken = {
        "null_key": F.col("nulls"),
        "duplicate_week": F.when(known, F.col("dated") - F.col("weeks")),
        "several_categories": F.when(known, F.greatest(F.col("categories") - 1, no)),
        "off_calendar": F.col("off"),
        "negative_demand": F.col("below"),
        "item_missing": F.when(known & (F.col("item") == 0), F.col("sale")),
        "duplicate_item": F.when(known, F.greatest(F.col("item") - 1, no)),
    }
    tagged = F.array(*(F.struct(F.lit(r).alias("rule"), broken[r].cast("long").alias("n")) for r in CONTRACT_RULES))
    return per.select("product_id", F.inline(tagged)).where("n > 0").select("rule", "product_id", "n")


def contract_report(demand: DataFrame, items: DataFrame, cfg: PlanConfig = DEFAULT) -> DataFrame:
    """(rule, n_products, n_breaks, example): one row a rule, also for those that nothing breaks."""
    found = contract_violations(demand, items, cfg)
    own = lambda r: F.col("rule") == r
    sums = found.agg(
        *(F.count_if(own(r)).alias(f"p_{r}") for r in CONTRACT_RULES),
        *(F.coalesce(F.sum(F.when(own(r), F.col("n"))), F.lit(0)).cast("long").alias(f"n_{r}") for r in CONTRACT_RULES),
        *(F.min(F.when(own(r), F.col("product_id"))).alias(f"e_{r}") for r in CONTRACT_RULES),
    )
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"p_{r}").alias("n_products"), F.col(f"n_{r}").alias("n_breaks"), F.col(f"e_{r}").alias("example")) for r in CONTRACT_RULES))
    return sums.select(F.inline(rows))


#: Rules whose break makes lags, statistics or joins wrong.
STRICT_RULES = {
    "duplicate_week": "demand has several rows for a product and week",
    "several_categories": "demand has several categories for a product",
    "duplicate_item": "items has several rows for a product",
}


def check_contract(demand: DataFrame, items: DataFrame) -> None:
    """Raise ``ValueError`` unless a product has one row per week, one category, and one item row.

    One job for all rules; lags, statistics and joins rely on them.
    """
    for r in contract_report(demand, items).collect():  # a row a rule
        if r.rule in STRICT_RULES and r.n_breaks:
            raise ValueError(f"{STRICT_RULES[r.rule]}, e.g. product_id {r.example}")


def read_canonical(spark: SparkSession, demand_path: str, items_path: str, fmt: str = "parquet", check: bool = True):
    """Bring-your-own data (X6): read canonical demand and item tables.

    ``check=False`` skips the contract check, for tables that were checked before.
    """
    demand = canonical_demand(spark.read.format(fmt).load(demand_path))
    items = canonical_items(spark.read.format(fmt).load(items_path))
    if check:
        check_contract(demand, items)
    return demand, items


def load_inputs(spark: SparkSession, sf_dir: str, before: str | None = None, costs_on_demand: bool = False):
    """(demand, items) built from the test tables at ``sf_dir``; see
    ``weekly_demand`` for ``before`` and ``costs_on_demand`` (``with_costs``)."""
    return weekly_demand(spark, sf_dir, before, costs_on_demand), items_from_parts(spark, sf_dir)
