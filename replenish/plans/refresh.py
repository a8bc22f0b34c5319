"""Incremental refresh of the planning state for a daily job (SNK1, SRC3, A1).

The state lives in two tables partitioned by month:

* ``weekly``: the roll-up, a row a product and week (product_id, date, demand, gap_weeks);
* ``moments``: count, total and sum of squared deviations (M2) of demand and lead
  time by product and month.

A load rolls up only the line items of its weeks (the bounds reach the scan),
replaces those weeks in the months they touch, and recomputes the moments of
these months; ``partitionOverwriteMode=dynamic`` rewrites their folders and no
other. Loading weeks again, late or corrected, therefore gives the same state as
loading everything once. The statistics of a product are its months' moments,
merged in the order of the months (pairwise formula of Chan et al.), so a
refresh reads the new weeks and one row a product and month.

A week belongs to the month of its Monday. Months before the cutoff come from
``moments``; of the cutoff's own month the weeks before it are read.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch
from ..sources.tables import first_monday_on_or_after, lead_time_of, weekly_totals

WEEKLY_SCHEMA = "product_id long, date timestamp_ntz, demand double, gap_weeks double, month string"
_STATS = ("n", "total", "m2", "lt_total", "lt_m2")
MOMENT_SCHEMA = "product_id long, n long, total double, m2 double, lt_total double, lt_m2 double, month string"


def month_of(date: Column) -> Column:
    return F.date_format(F.to_date(date), "yyyy-MM")


def months_between(since: str, before: str) -> list[str]:
    """The months that hold a Monday in [since, before)."""
    day, end = first_monday_on_or_after(since), dt.datetime.fromisoformat(before)
    out: list[str] = []
    while day < end:
        if not out or out[-1] != f"{day:%Y-%m}":
            out.append(f"{day:%Y-%m}")
        day += dt.timedelta(days=7)
    return out


@dataclass(frozen=True)
class Store:
    """The month-partitioned state under ``path``, a folder that all executors see."""

    path: str

    def _read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        # The declared schema keeps the partition column a string and skips inference.
        return spark.read.schema(schema).parquet(f"{self.path.rstrip('/')}/{table}")

    def weekly(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "weekly", WEEKLY_SCHEMA)

    def moments(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "moments", MOMENT_SCHEMA)

    def _path(self, spark: SparkSession, folder: str):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{folder}")
        return target.getFileSystem(spark._jsc.hadoopConfiguration()), target

    def exists(self, spark: SparkSession) -> bool:
        files, target = self._path(spark, "weekly")
        return files.exists(target)

    def drop_months(self, spark: SparkSession, months: list[str]) -> None:
        """Months without any row left; dynamic overwrite would keep their old folders."""
        for table in ("weekly", "moments"):
            for month in months:
                files, target = self._path(spark, f"{table}/month={month}")
                files.delete(target, True)

    def _write(self, rows: DataFrame, table: str) -> None:
        """Rewrite the months in ``rows``; a month is spread over files by product, so none is one task's."""
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = rows.repartition("month", F.pmod(F.xxhash64("product_id"), F.lit(n)))
        writer = spread.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{self.path.rstrip('/')}/{table}")


def monthly_moments(weekly: DataFrame) -> DataFrame:
    """(product_id, month, n, total, m2, lt_total, lt_m2) from weekly rows."""
    lead = lead_time_of(F.col("gap_weeks"))
    n = F.count("*")
    return weekly.groupBy("product_id", "month").agg(
        n.alias("n"),
        F.sum("demand").alias("total"),
        (F.var_pop("demand") * n).alias("m2"),
        F.sum(lead).alias("lt_total"),
        (F.var_pop(lead) * n).alias("lt_m2"),
    )


def load(spark: SparkSession, store: Store, sf_dir: str, since: str, before: str) -> list[str]:
    """Roll up the weeks in [since, before) and put them into the state; the months rewritten.

    Weeks that were loaded before are replaced, so a late or corrected week is loaded by
    its dates again. Safe to repeat after a failure: the same weeks give the same folders.
    """
    months = months_between(since, before)
    if not months:
        return []
    low, high = (first_monday_on_or_after(x) for x in (since, before))
    inside = (F.col("date") >= F.lit(low.isoformat(sep=" ")).cast("timestamp_ntz")) & (F.col("date") < F.lit(high.isoformat(sep=" ")).cast("timestamp_ntz"))
    fresh = weekly_totals(spark, sf_dir, before, since).withColumn("month", month_of(F.col("date")))
    with scratch():
        rows = fresh.select("product_id", "date", "demand", "gap_weeks", "month")
        if store.exists(spark):
            kept = store.weekly(spark).where(F.col("month").isin(months) & ~inside)
            rows = rows.unionByName(kept)
        rows = materialize(rows, "refreshed-weeks")  # the months are read before they are rewritten
        store._write(rows, "weekly")
        store._write(monthly_moments(rows), "moments")
        left = {r.month for r in rows.select("month").distinct().collect()}  # at most the months of the load
        store.drop_months(spark, sorted(set(months) - left))
    return months


def merged(months: DataFrame) -> DataFrame:
    """Per product: n, total, m2, lt_total, lt_m2 of all its months, merged in their order (bounded by the calendar)."""

    def join(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = a["n"].cast("double") * b["n"] / n

        def pair(total: str, m2: str) -> list[Column]:
            gap = b[total] / b["n"] - a[total] / a["n"]
            return [(a[total] + b[total]).alias(total), (a[m2] + b[m2] + gap * gap * share).alias(m2)]

        return F.struct(n.alias("n"), *pair("total", "m2"), *pair("lt_total", "lt_m2"))

    rows = months.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("month", *_STATS))).alias("parts"))
    first = F.struct(*(F.col("parts")[0][c].alias(c) for c in _STATS))
    total = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), first, join)
    return rows.select("product_id", F.inline(F.array(total)))


def product_stats(spark: SparkSession, store: Store, before: str) -> DataFrame:
    """The statistics of ``policy.product_stats`` for all weeks before the cutoff, from the stored state."""
    cut = first_monday_on_or_after(before)
    own = f"{cut:%Y-%m}"
    done = store.moments(spark).where(F.col("month") < own)
    part = store.weekly(spark).where((F.col("month") == own) & (F.col("date") < F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz")))
    rows = merged(done.unionByName(monthly_moments(part)))
    deviation = lambda m2: F.when(F.col("n") > 1, F.sqrt(F.col(m2) / (F.col("n") - 1)))
    return rows.select(
        "product_id",
        (F.col("total") / F.col("n")).alias("demand_avg"),
        deviation("m2").alias("demand_std"),
        (F.col("lt_total") / F.col("n")).alias("lead_time_avg"),
        deviation("lt_m2").alias("lead_time_std"),
    )


def weeks(spark: SparkSession, store: Store, since: str, before: str) -> DataFrame:
    """(product_id, date, demand, lead_time) of the weeks in [since, before), reading only their months' folders."""
    low, high = (F.lit(first_monday_on_or_after(x).isoformat(sep=" ")).cast("timestamp_ntz") for x in (since, before))
    rows = store.weekly(spark).where(F.col("month").isin(months_between(since, before)) & (F.col("date") >= low) & (F.col("date") < high))
    return rows.select("product_id", "date", "demand", lead_time_of(F.col("gap_weeks")).alias("lead_time"))
