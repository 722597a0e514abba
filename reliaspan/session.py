"""Session settings used by tests, the benchmark and the local checker."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "reliaspan") -> SparkSession:
    """A local session. On a cluster the caller brings its own session instead."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local session gets a fresh one where none is set.

    On a cluster an unset folder is an error: one that executors do not share would lose data.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def spread(df, *keys):
    """Hash the rows over every core before a compute-heavy kernel.

    Packed rows are few and small, so size-based coalescing would leave them in one task; an
    explicit partition count keeps the session's parallelism.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def materialise(df):
    """Reliable checkpoint of a table that several later steps read, so it is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df):
    """A table of a loop, written as Parquet beside the checkpoints and read again.

    A checkpoint keeps the estimated size of its plan, for a join the product of both sides. Where a loop joins what it
    made in the round before, that number doubles its digits in each round, and planning soon takes longer than the work;
    files are as large as they are.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
