"""Shared plumbing of the text operators: inputs, intermediates, checked broadcasts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder

#: Rows in an Arrow batch at most: texts are long, and a batch is held several times over.
BATCH_ROWS = 1_000
#: Rows of a two-long-column table that may be broadcast (about 32 MB); counted first.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage: later steps reread files that survive lost executors.
    The files go when the enclosing ``session.scratch`` block or the program ends.
    """
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers of this session import this package from the driver's path, and bound their batches.

    On a cluster the package is installed or shipped with ``--py-files``; this
    covers sessions whose workers share the driver's file system. The session's
    Arrow batch size is lowered to BATCH_ROWS if it is larger.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One Arrow batch in, one out; ``f`` returns None to emit nothing."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the distinct one-column table ``ids``.

    The id side is broadcast only after it was counted and found small;
    beyond that both sides are shuffled. Same rows either way.
    """
    n = ids.count() if n_ids is None else n_ids
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, key, "left_semi")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over ``edges`` (a, b longs).

    Rounds of hooking to the smallest neighbour, one pointer jump, then
    contraction of the edges; every round is written to the shared folder.
    Only ids that have an edge appear. Self loops and nulls are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = written(spark, e, "edges")
    result: DataFrame | None = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))
        hook = written(spark, hook, "hook")
        up = hook.select(F.col("id").alias("root"), F.col("root").alias("up"))
        hook = hook.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        hook = written(spark, hook, "jump")
        if result is None:
            result = hook
        else:
            step = hook.select(F.col("id").alias("root"), F.col("root").alias("up"))
            result = result.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
            result = written(spark, result, "roots")
        ra = hook.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        rb = hook.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        e = e.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e = written(spark, e, "edges")
    return result if result is not None else spark.createDataFrame([], "id long, root long")
