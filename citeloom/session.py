"""Session settings and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app_name: str = "citeloom", master: str | None = None, driver_memory: str | None = None
) -> SparkSession:
    """A session with adaptive execution on and the clock pinned to UTC.

    On a cluster ``master`` and memory come from spark-submit; only settings
    the operators rely on are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    Executors must all see it, so it lives under ``spark.checkpoint.dir``. Only
    a session that names no such folder (tests on one machine) falls back to a
    temporary one, and a cluster session without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = os.path.join(tempfile.gettempdir(), "citeloom")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, *partition_by: str, options: dict | None = None) -> DataFrame:
    """Write a Parquet table and return a DataFrame that reads it back."""
    writer = df.write.mode("errorifexists").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 256 * 1024 * 1024


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a side whose row count has a proven ceiling, if it fits.

    Beyond the limit the hint is left out and the join shuffles (adaptive
    execution splits skewed keys).
    """
    return F.broadcast(df) if max_rows * row_bytes <= BROADCAST_BYTES else df


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain table scan at least as many partitions as there are cores.

    Only a table too small to be split is moved; a large scan already has more
    partitions than that and is returned unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def by_question(df: DataFrame) -> DataFrame:
    """Rows of a question together, questions over all cores.

    A fixed number of partitions keeps adaptive execution from merging small
    rows into one task when the work on each is heavy.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, "query_id")
