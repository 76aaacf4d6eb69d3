"""Session construction and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tastemill", cpus: int | str = "*", shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps.

    On a cluster the master and the executor sizes come from spark-submit; a local master is set only where nothing names one.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    # spark-submit starts Python with the port of its gateway; without it, submit arguments may still name a master.
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if "spark.master" not in conf and not submitted:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    conf.pop("driver_memory", None)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a local one is made only for a local master without a setting."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        configured = tempfile.mkdtemp(prefix="tastemill-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table or a stream checkpoint."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write once into the shared folder and read the table: lineage ends there, so the loss of executors costs no
    recomputation, columns can be pruned, and the optimizer knows the real size."""
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
