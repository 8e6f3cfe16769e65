"""Session construction and the shared run folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "rankweave", **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    UTC keeps day boundaries fixed, AQE re-plans joins from measured sizes and splits
    skewed partitions. Everything else is left to the cluster's own defaults.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once per application.

    The archive is built next to the driver; Spark copies it to every executor.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "rankweave"), "zip", root, "rankweave")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a folder on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    named = spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "rankweave-checkpoints")
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


_runs: list[str] = []


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _runs.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing `df` to the shared folder and reading it back."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_runs(spark: SparkSession) -> None:
    """Delete every folder `run_dir` has named in this application.

    For jobs that have consumed their results: frames that read such a folder end with it.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _runs:
        path = jvm.org.apache.hadoop.fs.Path(_runs.pop())
        path.getFileSystem(conf).delete(path, True)
