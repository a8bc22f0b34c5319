"""A third of all line items on one order and one part: results stay exact,
the order join is split by AQE, and no task sees the hot part's raw lines
after the map-side (part, week) aggregation."""

import io
import os
import sys
import tempfile
from contextlib import redirect_stdout

import duckdb
import pytest
from pyspark.sql import functions as F

from paths import ROOT, SF0001

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as entry  # noqa: E402
from check_oracle import frame_hash  # noqa: E402

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def skewed_dir(spark):
    """Line items of sf0.001 with every third row moved onto order 1 and part 1."""
    out = tempfile.mkdtemp(prefix="replenish-skew-")
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    hot = F.pmod(F.col("l_linenumber") + F.col("l_orderkey"), F.lit(3)) == 0
    li = li.withColumns(
        {
            "l_orderkey": F.when(hot, F.lit(1).cast("long")).otherwise(F.col("l_orderkey")),
            "l_partkey": F.when(hot, F.lit(1).cast("long")).otherwise(F.col("l_partkey")),
        }
    )
    # Several files, so several map tasks: AQE splits a skewed partition along
    # map-output boundaries (a cluster input has thousands of files).
    li.repartition(8).write.parquet(f"{out}/lineitem.parquet")
    for t in ("orders", "part"):
        spark.read.parquet(f"{SF0001}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_keys_still_match_oracle(spark, skewed_dir, skew_conf):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet/*.parquet')")
    sql = entry.oracle_sql()
    for name in ("weekly_demand", "policy_params", "plan_comparison", "product_comparison"):
        got = entry.queries()[name](spark, skewed_dir).toPandas()
        want = con.sql(sql[name]).df()
        assert len(got) == len(want), name
        assert frame_hash(got) == frame_hash(want), name


def test_order_join_is_split_by_aqe(spark, skewed_dir, skew_conf):
    df = entry.queries()["weekly_demand"](spark, skewed_dir)
    df.collect()  # run this DataFrame's own plan so explain shows the final one
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    text = buf.getvalue()
    assert "isFinalPlan=true" in text
    assert "SortMergeJoin(skew=true)" in text
