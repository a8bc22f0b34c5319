"""Incremental refresh: the stored state equals a full recompute, and only touched months are rewritten."""

import os

import pytest
from pyspark.sql import functions as F

from replenish.config import DEFAULT
from replenish.operators import policy, split
from replenish.plans import refresh
from replenish.plans.queries import finish
from replenish.sources.tables import weekly_demand

from paths import SF0001

START, END = DEFAULT.calendar_start, DEFAULT.test_cutoff


def same(a, b):
    cols = a.columns
    return a.exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a).isEmpty()


def files(path, table="weekly"):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(f"{path}/{table}") for f in names if f.startswith("part-")}


@pytest.fixture()
def early(spark, tmp_path):
    """The input as it was before the last lines of one week arrived, and with lines of another that went later."""
    folder = f"{tmp_path}/early"
    for t in ("orders", "part"):
        spark.read.parquet(f"{SF0001}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    lines = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    late = F.col("l_shipdate").between("1999-05-03", "1999-05-09 23:59:59") & (F.col("l_linenumber") > 1)
    gone = lines.where("l_shipdate >= '1997-02-03' and l_shipdate < '1997-02-10'").withColumn("l_quantity", F.col("l_quantity") * 3)
    lines.where(~late).unionByName(gone).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def full_stats(spark):
    train = split.split_train_test(weekly_demand(spark, SF0001, DEFAULT.train_cutoff), DEFAULT)[0]
    return finish(policy.product_stats(train))


def test_state_after_loads_equals_a_full_recompute(spark, tmp_path, early):
    store = refresh.Store(f"{tmp_path}/state")
    cuts = (START, "1996-08-14", "1999-05-06", END)  # in the middle of weeks and months
    for since, before in zip(cuts, cuts[1:]):
        refresh.load(spark, store, early, since, before)
    got = finish(refresh.product_stats(spark, store, DEFAULT.train_cutoff))
    assert not same(got, full_stats(spark))  # two weeks are still wrong
    assert refresh.load(spark, store, SF0001, "1999-05-03", "1999-05-10") == ["1999-05"]
    refresh.load(spark, store, SF0001, "1997-02-03", "1997-02-10")
    assert same(finish(refresh.product_stats(spark, store, DEFAULT.train_cutoff)), full_stats(spark))
    weeks = weekly_demand(spark, SF0001, END).select("product_id", "date", "demand", "lead_time")
    assert same(refresh.weeks(spark, store, START, END), weeks)


def test_a_reload_rewrites_its_months_only(spark, tmp_path):
    path = f"{tmp_path}/state"
    store = refresh.Store(path)
    refresh.load(spark, store, SF0001, START, END)
    before = {t: files(path, t) for t in ("weekly", "moments")}
    assert refresh.load(spark, store, SF0001, "1998-06-29", "1998-07-13") == ["1998-06", "1998-07"]
    for t, old in before.items():
        new = files(path, t)
        changed = {f.split("/")[1] for f in old ^ new}
        assert changed == {"month=1998-06", "month=1998-07"}, t
        assert old & new


def test_a_month_without_rows_goes(spark, tmp_path, early):
    store = refresh.Store(f"{tmp_path}/state")
    refresh.load(spark, store, SF0001, "1997-01-06", "1997-04-07")
    empty = f"{tmp_path}/empty"
    for t in ("orders", "part"):
        spark.read.parquet(f"{SF0001}/{t}.parquet").write.parquet(f"{empty}/{t}.parquet")
    spark.read.parquet(f"{SF0001}/lineitem.parquet").where("l_shipdate < '1997-02-03' or l_shipdate >= '1997-03-03'").write.parquet(f"{empty}/lineitem.parquet")
    refresh.load(spark, store, empty, "1997-02-03", "1997-03-03")
    months = [r.month for r in store.weekly(spark).select("month").distinct().orderBy("month").collect()]
    assert months == ["1997-01", "1997-03"]
    assert {r.month for r in store.moments(spark).select("month").distinct().collect()} == {"1997-01", "1997-03"}


def test_reads_prune_folders(spark, tmp_path):
    store = refresh.Store(f"{tmp_path}/state")
    refresh.load(spark, store, SF0001, "1998-01-05", "1999-01-04")
    df = refresh.weeks(spark, store, "1998-05-04", "1998-06-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "1998-05" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert df.count() > 0
    assert {f.split("month=")[1][:7] for f in df.inputFiles()} >= {"1998-05"}


def test_nothing_to_load(spark, tmp_path):
    store = refresh.Store(f"{tmp_path}/state")
    assert refresh.load(spark, store, SF0001, "1998-01-06", "1998-01-12") == []
    assert not store.exists(spark)


def test_cutoff_inside_a_month(spark, tmp_path):
    store = refresh.Store(f"{tmp_path}/state")
    refresh.load(spark, store, SF0001, START, END)
    cfg = DEFAULT.with_(train_cutoff="2000-03-15")
    train = split.split_train_test(weekly_demand(spark, SF0001, cfg.train_cutoff), cfg)[0]
    assert same(finish(refresh.product_stats(spark, store, cfg.train_cutoff)), finish(policy.product_stats(train)))
