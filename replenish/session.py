"""Session helpers.

``get_session`` is for tests, the bench and local runs only. Library code
never builds a session; it takes the caller's and only reads settings from
it (``shared_dir``).
"""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "replenish") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("REPLENISH_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers of this session import this package from the driver's path.

    On a cluster the package is installed or shipped with ``--py-files``; this
    covers sessions whose workers share the driver's file system.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Where a session that runs in one process keeps intermediates if it names no folder.
LOCAL_DIR = "/tmp/checkpoints"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Executors write there and others read it back, so on a cluster (and under
    Spark Connect) it must be named; only a ``local[...]`` session may do without.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return LOCAL_DIR
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def materialize(df, name: str, partition_by: str | None = None):
    """Write ``df`` once as Parquet under the shared folder and read it back.

    A lineage cut that is computed a single time (an unpersisted
    ``checkpoint()`` computes its input twice) and survives lost executors.
    Filters on ``partition_by`` prune folders. The files go when the enclosing
    ``scratch`` block or the program ends.
    """
    return stored(df, name, partition_by)[0]


def stored(df, name: str, partition_by: str | None = None):
    """As ``materialize``, with the folder, for a caller that will ``discard`` it sooner."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``stored`` now; frames that read it are dead then."""
    _remove([(spark, folder)])


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; it goes when the enclosing ``scratch`` block or the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _remove(entries: list[tuple[SparkSession, str]]) -> None:
    for spark, path in entries:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove((spark, path))


@contextlib.contextmanager
def scratch():
    """Delete on leaving what ``materialize`` wrote inside; frames that read it are dead then."""
    before = len(_written)
    try:
        yield
    finally:
        _remove(_written[before:])


@atexit.register
def _remove_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _remove(list(_written))
