"""Session helpers: shared scratch folder, materialised intermediates, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast, or a group kept in one task, up to this many rows.
BROADCAST_ROWS = 200_000
TASK_ROWS = 2_000_000


# Settings for a large cluster; `spark.checkpoint.dir` must name a shared folder there.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Start with many small shuffle partitions and let AQE merge them to this size.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Windows ask for all of their keys, not for a coarser partitioning left by a join.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by `spark.checkpoint.dir`.

    A local session without the setting gets a folder of its own; a cluster
    session without it gets None, since a machine-local folder would be lost.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None and named:
        sc.setCheckpointDir(named)
    elif current is None and sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="vigipanel-")
        # The steps of a local session go with the process.
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return named or sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, wherever the driver was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="vigipanel-"), "vigipanel.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    # One folder per application, so that all its steps can be removed with it.
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Compute an intermediate once and cut its lineage: a table in the shared folder.

    Parquet rather than an RDD checkpoint, so that later jobs read only the columns they
    use and the planner knows the size.  On a cluster without a shared folder this fails,
    for a step that is evaluated twice need not give the same rows twice.  `options` are the
    Parquet writer's.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_steps(spark: SparkSession) -> None:
    """Delete what this application has stored; call it before the session stops."""
    folder = shared_folder(spark)
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a per-group table and mark it for broadcast if its size allows.

    Beyond the bound it is returned unmarked, so that the join shuffles and AQE
    splits whatever keys are skewed.
    """
    table = materialise(df)
    return F.broadcast(table) if table.count() <= rows else table


def bounded_by(df: DataFrame, source: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast a table that has at most one row per row of `source`.

    Only `source`, a stored table, is counted; `df` itself is not computed for the check.
    """
    return F.broadcast(df) if source.count() <= rows else df


def cluster_session(**conf: str) -> SparkSession:
    """A session with the settings for a large cluster; needs spark.checkpoint.dir."""
    builder = SparkSession.builder.appName("vigipanel")
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    scratch_path(spark, "check")  # fails now rather than in the middle of a job
    return spark


def local_session(cpus: int | str = 8, memory: str = "16g", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vigipanel")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
